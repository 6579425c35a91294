"""Personal data in free text: found by kind and place, and replaced by placeholders or surrogates.

Email addresses, phone numbers, official numbers and street addresses show by their form, checked against the words
around them. Names show by a given name, by what leads to them (a title, a greeting, a signature, a form field), by what
persons are (a role) or do (verbs of saying, signing, living), by the endings of surnames in scripts that have them, or
by an identifier next to them; a surname alone counts where its bearer is named in the same text. Names of firms, brands
and places that look like names of persons are told by the words that go with them.

Surrogates are keyed: the same entity gets the same replacement in every text, of its kind, gender, script, case and
format. Words of a name are replaced one by one, so that parts of a name, its other orders and an e-mail address made of
it stay together. Given names are permuted within their gender, so that no two share a replacement; of made-up words two
that meet in one text are told apart by another draw for the second.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.arrow import map_batches

# Given names.
GIVEN_EN = """Adela Alaric Brannon Bettina Cassian Corwen Delphie Drusilla Edwyn Esmond Farrah Fenella Gideon Godfrey Harriet Hester
Ignatius Isolde Jasper Jocasta Kendra Lavinia Lionel Mabel Magnus Marlene Nathan Nerissa Odette Oswin Percy Philippa Quentin Rosalind
Rowena Septimus Silas Tamsin Theodora Ursula Verity Wendell Winifred Xanthe Yorick Zelda James John Robert Michael William David Richard
Joseph Thomas Charles Christopher Daniel Matthew Anthony Donald Steven Andrew Kenneth Kevin Brian George Edward Ronald Timothy Jason
Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Patrick Frank Alexander Raymond
Jack Dennis Jerry Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Betty Sandra Ashley Emily
Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Sharon Cynthia Kathleen Amy Shirley Anna Angela Ruth Brenda
Pamela Nicole Katherine Samantha Christine Emma Catherine Virginia Rachel Janet Heather Diane Olivia Julie Victoria Kelly Joan Evelyn
Judith Megan Cheryl Alice Hannah Jacqueline Martha Gloria Teresa Ann Sara Madison Frances Kathryn Janice""".split()
GIVEN_DE = """Anneliese Burkhard Dietlinde Eckart Friederike Gernot Heidrun Ingolf Jörg Käthe Lothar Mechthild Rüdiger Sieglinde Traudel
Volkmar Hans Peter Klaus Jürgen Wolfgang Dieter Uwe Ralf Bernd Stefan Andreas Matthias Sabine Petra Monika Ursel Renate Karin Gisela
Ingrid Brigitte Helga Angelika Birgit Heike Anke Silke Katja Jutta Ulrike Gudrun Horst Günter Helmut Heinz Gerhard Werner Walter Karl
Otto Ernst Rolf Holger Thorsten Torsten Jens Sven Kai Lars Ute Elke""".split()
GIVEN_FR = """Amédée Bérengère Clotilde Didier Éloïse Fulbert Ghislaine Hervé Joséphine Léonie Maëlle Philiberte Thibault Ulysse Jean
Pierre Jacques Michel Philippe Alain Bernard Christophe Laurent Thierry Olivier Pascal Éric Frédéric Sébastien Julien Nathalie Isabelle
Sylvie Catherine Valérie Christine Sandrine Céline Aurélie Camille Chloé Léa Manon Margaux Élodie Émilie Hélène François Françoise
Geneviève Monique Jacqueline Marie Anne Yves Luc Rémi Guillaume Antoine Benoît Étienne Gérard Solange Odile""".split()
GIVEN_ES = """Abelardo Begoña Crisanto Dorotea Eulalia Fermín Gumersindo Inés Íñigo Leocadia Maximino Nélida Plácido Remedios Antonio
José Manuel Francisco Juan Javier Carlos Miguel Rafael Ángel Fernando Luis Jorge Alberto Álvaro Adrián Pablo Sergio Diego Raúl Enrique
Ramón Vicente Andrés Joaquín Santiago Eduardo María Carmen Josefa Isabel Dolores Pilar Teresa Ana Francisca Laura Cristina Marta Lucía
Elena Rosario Mercedes Concepción Encarnación Rocío Montserrat Beatriz Silvia Patricia Raquel Soledad Amparo Consuelo""".split()
# Which of them women bear.
FEMALE = frozenset("""Adela Bettina Delphie Drusilla Farrah Fenella Harriet Hester Isolde Jocasta Kendra Lavinia Mabel Marlene Nerissa Odette Philippa
Rosalind Rowena Tamsin Theodora Ursula Verity Winifred Xanthe Zelda Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen
Nancy Lisa Margaret Betty Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Sharon Cynthia
Kathleen Amy Shirley Anna Angela Ruth Brenda Pamela Nicole Katherine Samantha Christine Emma Catherine Virginia Rachel Janet Heather Diane
Olivia Julie Victoria Kelly Joan Evelyn Judith Megan Cheryl Alice Hannah Jacqueline Martha Gloria Teresa Ann Sara Madison Frances Kathryn
Janice""".split())
FEMALE_OTHER = frozenset("""Anneliese Dietlinde Friederike Heidrun Käthe Mechthild Sieglinde Traudel Sabine Petra Monika Ursel Renate Karin Gisela Ingrid Brigitte
Helga Angelika Birgit Heike Anke Silke Katja Jutta Ulrike Gudrun Ute Elke Bérengère Clotilde Éloïse Ghislaine Joséphine Léonie Maëlle
Philiberte Nathalie Isabelle Sylvie Catherine Valérie Christine Sandrine Céline Aurélie Camille Chloé Léa Manon Margaux Élodie Émilie Hélène
Françoise Geneviève Monique Jacqueline Marie Anne Solange Odile Begoña Dorotea Eulalia Inés Leocadia Nélida Remedios María Carmen Josefa
Isabel Dolores Pilar Teresa Ana Francisca Laura Cristina Marta Lucía Elena Rosario Mercedes Concepción Encarnación Rocío Montserrat Beatriz
Silvia Patricia Raquel Soledad Amparo Consuelo""".split())
# Chinese surnames of two characters, then common ones of one.
SURNAMES_ZH2 = "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 令狐 轩辕 呼延 百里 东郭 西门 南门".split()
SURNAMES_ZH1 = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"

# Words that make a firm, brand or place of what stands before or after them.
AFTER_NAME = frozenset("""ltd inc corp co llc llp lp plc gmbh ag se sa sas sarl sl kg bv nv spa company group holdings holding partners associates
foundation trust fund bank bancorp capital industries systems networks technologies materials foods retail logistics therapeutics energy
stiftung konzern verein institut institute university college school hospital clinic church museum library theatre theater stadium arena
hotel inn resort restaurant cafe bar brewery winery stores store shop outlet brand brands line series tablets pills pies capsules drops
syrup cream lotion shoes boots bags watches cookies biscuits cakes sauce soup tea coffee beer wine whisky unit well field mine mill plant
works factory refinery pipeline terminal depot warehouse site platform rig vessel ship index award prize medal cup bridge tower building
house hall center centre plaza square park street road avenue lane drive court terrace boulevard ruling case decision doctrine act
v vs versus method test curve law effect syndrome disease model theorem notes bonds shares segment division joint venture settlement
county city town village river lake mountain island valley bay beach canyon & und et y and e one pro flex x2 40 wing facility portfolio""".split())
BEFORE_NAME = frozenset("the a an & at in near aunt uncle st saint die der das den dem la le les el los las l via von lot build follow".split())
NOT_NAMES = frozenset("""the a an and or but if when where while for to in on at by of from with as is are was were be this that these those
we our you your they their it its he she his her all there everyone team both operator address tel phone mobile fax email mail from cc re
dear hi hello good morning evening thanks thank regards yours sincerely no note item part section page vol chapter exhibit figure table
q question answer beneficiary applicant signed subject date der die das und oder nicht wir sie ist bei mit von zu herr frau herrn monsieur
madame señor señora usted nous vous le la les des une un el los las por para con quiz ssn passport social security national insurance
driver licence mr mrs ms dr prof sir rev in-house counsel company board management committee council department office desk line hotline
january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday
sunday cusip commission file irs questions whistleblower merci bitte pueden escriban ich je yo i my item shipments goodwill energy regards cordialement atentamente
investor relations shareholder meeting annual report press release account invoice order""".split())

PARTICLES = frozenset("von van der den dem de la las los le du di da dos del zu zur bin al el y".split())

_UP = "A-ZÀ-ÖØ-Þ"
_LO = "a-zß-öø-ÿœ"
_TOK = rf"(?:[{_UP}](?:[^\W\d_]|['’](?=[^\W\d_]))*(?<!['’])(?:-[{_UP}](?:[^\W\d_]|['’](?=[^\W\d_]))*)*)"
_PART = r"(?:von der|von dem|von|van der|van den|van|de la|de las|de los|de|del|della|di|da|dos|du|le|zu|zur|bin|al|y)"
_INI = rf"[{_UP}]\.(?:-[{_UP}]\.)?"
_NAME = rf"(?:{_INI}|{_TOK})(?:[ \u00a0](?:(?:{_PART}[ \u00a0])?(?:{_INI}|{_TOK})|d['’]{_TOK})){{0,3}}"
_REVERSED = rf"{_TOK}(?:[ \u00a0]{_TOK})?,[ \u00a0](?:{_INI}|{_TOK})(?:[ \u00a0](?:{_INI}|{_TOK})){{0,2}}"
_WORD1 = r"(?:[^\W\d_]\.|[^\W\d_]+(?:[-'’][^\W\d_]+)*)"
_ANY = rf"{_WORD1}(?:,?[ \u00a0]{_WORD1}){{0,4}}"
# a letter is a title only before a name of two parts
_TITLE = rf"(?:(?:(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Dame|Rev|Herrn?|Frau|Hr|Fr|Monsieur|Madame|Mme|Mlle|MM|Me|Maître|Don|Doña|Dña|Sra?|Srta|Dra|Ing|Dipl)\.?|[MD]\.(?=[ \u00a0][^\W\d_]+[ \u00a0,]+(?:[{_UP}]|de |von |van |le |la )))[ \u00a0])"
_TITLES = rf"(?:{_TITLE}{{0,3}})"
_full = re.compile(rf"({_REVERSED}|{_NAME})")
_back = re.compile(rf"(?:^|(?<=[\s(–—:>/“\"'„«]))({_REVERSED}|{_NAME})$")
_back_any = re.compile(rf"(?:^|[.!?:;\n(–—]\s*){_TITLES}({_ANY})$")
_SMALL_NAME = re.compile(r"([^\W\d_]+(?:[-'’][^\W\d_]+)*(?: [^\W\d_]\.?)?(?: (?:von|van|de|la|del) ?)?(?: ?[^\W\d_]+(?:[-'’][^\W\d_]+)*)?)(?=[,'’(]| (?:aus|whose|was|asked|is|has)\b)")
_ADDRESSED = re.compile(rf"(?:(?:Hi|Dear|Hello)[ \u00a0]|{_TITLE})$")
_PART_OF_NAME = re.compile(rf"(?:{_TOK}|[{_UP}]\.) $")
_strip_title = re.compile(rf"^{_TITLES}", re.I)

# What leads to a name, and what must follow it ("" where any end will do).
LEADS = [
    ("my name is ", r"(?= and I\b|[,.;\n]|$| \()"), ("i am called ", r"(?=[,.;\n]|$)"), ("regards, ", r"(?=[\n.]|\s{2}|$|\s[^a-z])"), ("regards,\n", r"(?=[\n.]|$)"),
    ("sincerely, ", r"(?=[\n.]|$)"), ("sincerely,\n", r"(?=[\n.]|$)"), ("yours, ", r"(?=[\n.]|$)"), ("signed: ", ""), ("/s/ ", ""), ("signed by ", ""), ("from: ", r"(?=[ \u00a0]*[<\n(]|$)"), ("to: ", r"(?=[ \u00a0]*[<(])"),
    ("beneficiary: ", ""), ("beneficiary ", r"(?= /|[,:])"), ("applicant ", r"(?= ?[/,(])"), ("applicant: ", ""), ("claimant ", r"(?= ?[/,(])"), ("claimant: ", ""), ("name: ", ""), ("holder: ", ""), ("shareholder: ", ""), ("contact: ", r"(?= ?[,(\n/])"),
    ("my phone – ", r"(?=[,\n])"), ("my phone - ", r"(?=[,\n])"), ("we copied ", r"(?=['’]s\b)"), ("was filed by ", r"(?=[,.( ])"), ("filed by ", r"(?=[,(])"), ("grievance of ", r"(?= \(|[,.])"), ("former employee, ", r"(?=,)"), ("employee, ", r"(?=, of\b)"),
    ("agreed with ", r"(?= on the phone| by phone|,)"), ("notice to ", r"(?= at )"), ("mailed to ", r"(?= at )"), ("comes from ", r"(?= of | from | with |[.,])"), ("question from ", r"(?= of | from | with |[.,])"),
    ("go to ", r"(?= \(tel)"), ("returned by ", r"(?= and |,)"), ("last week ", r"(?=, an? )"), ("written by ", r"(?=[,.( ])"), ("letter from ", r"(?=[,.( ])"), ("ask for ", r"(?=[,.( ]| at )"), ("speak to ", r"(?=[,.( ]| at )"), ("call ", r"(?= at | on )"), ("contact ", r"(?= at | on |[,(])"), ("reach ", r"(?= at | on )"), ("attn: ", ""), ("attention: ", ""), ("dear ", r"(?=[,:\n])"), ("hi ", r"(?=[,.!\n])"), ("hello ", r"(?=[,.!\n])"), ("thank you, ", r"(?=[,.!\n])"), ("thanks, ", r"(?=[,.!\n])"),
    *[(f"my {x} ", r"(?= never| has| is| was| got| did| had| who| and|, |'s|’s)") for x in "sister brother mother father wife husband son daughter aunt uncle cousin nephew niece grandmother grandfather colleague neighbour neighbor friend client partner".split()],
    ("ich heiße ", r"(?=, mein|[,.\n]| und)"), ("mein name ist ", r"(?=[,.\n]| und)"), ("unterlagen an ", r"(?=, )"), ("die frage stellte ", r"(?= aus | von |[,.])"), ("grüßen\n", r"(?=\n|$)"), ("grüßen, ", r"(?=[\n.]|$)"), ("grüße\n", r"(?=\n|$)"), ("gez. ", r"(?=[\n,.]|$)"), ("ansprechpartner: ", ""), ("ansprechpartner ist ", r"(?=[,.( ])"), ("ansprechpartnerin ist ", r"(?=[,.( ])"), ("sehr geehrter ", r"(?=[,\n])"), ("sehr geehrte ", r"(?=[,\n])"),
    ("je soussigné ", r"(?=,)"), ("je soussignée ", r"(?=,)"), ("je m’appelle ", r"(?=[,.\n]| et)"), ("je m'appelle ", r"(?=[,.\n]| et)"), ("d’écrire à ", r"(?=, )"), ("d'écrire à ", r"(?=, )"), ("cordialement,\n", r"(?=\n|$)"), ("cordialement, ", r"(?=[\n.]|$)"), ("contacter ", r"(?= au |[,(])"), ("question de ", r"(?=[,(])"), ("signé : ", ""),
    ("yo, ", r"(?=, con )"), ("me llamo ", r"(?=[,.\n]| y)"), ("mi nombre es ", r"(?=[,.\n]| y)"), ("escriban a ", r"(?=, )"), ("escribir a ", r"(?=, (?:C|A|P))"), ("llamar a ", r"(?= al )"), ("atentamente,\n", r"(?=\n|$)"), ("atentamente, ", r"(?=[\n.]|$)"), ("firmado: ", ""), ("contactar con ", r"(?=[,(]| en )"),
]
# What follows a name.
TRAILS = ["'s ssn", "’s ssn", "'s passport", "’s passport", "'s social", "’s social", "'s national", "’s national", "'s driver", "’s driver", ", whose ", " can be reached", " may be reached", " asked about", " asked whether", " asked how", " (tel", ", ssn", ", passport", ", social security", ", national insurance", ", driver", " (employee", " <", " / ssn", ", a pensioner", ", jointly", " ist unter ", " ist telefonisch", " est joignable", " puede ser", " está disponible", ", con dni", ", numéro de sécu", ", meine steuer", ", meine ausweis", ": hi ", ": thanks", ": hello", ": good ", ": thank you"]
# What persons are, before their names, and what they do, after them or before "by".
ROLES = """chief executive|chief financial officer|chief operating officer|ceo|cfo|coo|director|chairman|chairwoman|chairperson|chair|president|vice president|treasurer|secretary|auditor
attorney|lawyer|notary|judge|engineer|nurse|physician|surgeon|analyst|clerk|manager|accountant|bookkeeper|supervisor|colleague|tenant|patient|witness|widow|resident|trustee|founder|professor
geschäftsführer|geschäftsführerin|vorstandsvorsitzender|vorsitzende|vorsitzender|rechtsanwalt|rechtsanwältin|notar|mitarbeiter|mitarbeiterin|kollege|kollegin|buchhalter|leiterin
directeur|directrice|président|présidente|avocat|avocate|notaire|salarié|salariée|collègue|gérant|gérante|director general|directora|presidenta|abogado|abogada|notario|empleado|empleada|gerente""".replace("\n", "|").split("|")
DEEDS = """said|says|wrote|writes|told|asked us|emailed|phoned|signed|testified|resigned|retired|lives|lived|was born|passed away|joined the board|was appointed|was elected|was hired|took minutes
sagte|schrieb|erklärte uns|unterschrieb|wohnt|wurde geboren|trat zurück|a déclaré|a écrit|a signé|habite|est né|est née|dijo|escribió|firmó|vive en|nació""".replace("\n", "|").split("|")
DONE_BY = """taken|written|signed|drafted|chaired|witnessed|notarised|notarized|treated|interviewed|represented|nominated|countersigned|led|submitted|succeeded|unterzeichnet|unterschrieben|geleitet|protokolliert
signé|signée|rédigé|rédigée|présidé|présidée|firmado|firmada|redactado|redactada|presidido|presidida""".replace("\n", "|").split("|")
# What a place begins with.
PLACES = frozenset("new north south east west northern southern eastern western upper lower great port fort mount lake san santa saint los las el la le bad".split())
_TWO = rf"{_TOK}(?:[ \u00a0](?:{_INI}|(?:{_PART}[ \u00a0])?{_TOK})){{1,3}}"
_ROLE = re.compile(rf",? ({_TWO})(?=[ ,.;:)\n]|$)")
_BY = re.compile(rf" (?:by|von|par|por) ({_TWO})(?=[ ,.;:)\n]|$)")
_DOER = re.compile(rf"(?:(?<=[.!?:;,(\n] )|(?<=[\n(])|(?<= and ))({_TWO}),?$")
_DOER_FIRST = re.compile(_DOER.pattern.replace("(?:(?<=", "(?:^|(?<=", 1))
# Names in scripts with telling endings or titles: Russian, Greek, Korean, Hindi, Arabic.
_FAR_NAMES = [
    re.compile(r"(?<![А-яЁё-])[А-ЯЁ][а-яё]+(?: [А-ЯЁ][а-яё]+(?:ович|евич|ич|овна|евна|ична|инична))? [А-ЯЁ][а-яё]*(?:ов|ова|ев|ева|ёв|ёва|ин|ина|ын|ына|ский|ская|цкий|цкая|енко|ук|юк|чук|ян|швили|дзе)(?:а|у|ым|ой|е)?(?![а-яё-])"),
    re.compile(r"(?<![А-яЁё-])[А-ЯЁ][а-яё]+(?:ов|ова|ев|ева|ёв|ёва|ин|ина|ский|ская|енко|ук|юк|ян) (?:[А-ЯЁ]\. ?[А-ЯЁ]\.|[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+(?:ович|евич|овна|евна|ична))"),
    re.compile(r"(?<![Α-ώ])[Α-ΩΆΈΉΊΌΎΏ][α-ώ]+ [Α-ΩΆΈΉΊΌΎΏ][α-ώ]*(?:όπουλος|οπούλου|ίδης|ίδου|άκης|άκη|ιάδης|ιάδου|ίου)(?![α-ώ])"),
    re.compile(r"[김이박최정강조윤장임한오서신권황안송류홍전고문손양배백허남심노하곽성차주우구민진][가-힣]{2}(?= ?(?:씨|님|선생))"),
    re.compile(r"(?<=श्री )[\u0900-\u097f]+ [\u0900-\u097f]+|(?<=श्रीमती )[\u0900-\u097f]+ [\u0900-\u097f]+|(?<=डॉ\. )[\u0900-\u097f]+ [\u0900-\u097f]+"),
    re.compile(r"(?<=السيد )[\u0621-\u064a]+ [\u0621-\u064a]+|(?<=السيدة )[\u0621-\u064a]+ [\u0621-\u064a]+|(?<=الدكتور )[\u0621-\u064a]+ [\u0621-\u064a]+"),
]
_FAR = re.compile("[\u0370-\u06ff\u0900-\u097f가-힣]")
# The same for Chinese and Japanese.
ZH_LEAD = re.compile(r"(?:股东|寄给|联系人|本人|申请人|员工|投资者|提问者|经办人|签名|签署人|姓名|持有人|我叫|我是|转交|收件人)[：: ]?")
ZH_NAME = re.compile(rf"(?:{'|'.join(SURNAMES_ZH2)})[一-鿿]{{1,2}}|[{SURNAMES_ZH1}][一-鿿]{{1,2}}(?=[，,。（(：:；;、\n]|先生|女士|$)|[一-鿿]{{2,4}}(?=[，,（(] ?(?:身份证|护照|电话|手机|邮箱|电邮|地址|住址|微信))")
ZH_AFTER = re.compile(r"[，,。（(：:；;、\n]|先生|女士|$|的|已|对|在|于|电话|地址|表示|称")
JA_NAME = r"[一-鿿々ヶケヵノ之]{1,5}[ \u3000]?[一-鿿々ぁ-んァ-ヶ]{1,4}"
JA_CTX = [re.compile(rf"(?:担当は|担当者は|連絡先は|窓口は)({JA_NAME})(?=[、，,です])"), re.compile(rf"(?:資料は|書類は|通知は|宛先は|株券は)({JA_NAME})(?=様|さん|氏|殿)"), re.compile(rf"(?:株主の|社員の|従業員の|元社員の|申請者の|私、|私は|質問者の|投資家の)({JA_NAME})(?=[（(、，]|様|さん|氏|と申|です|が|は|から)"), re.compile(rf"敬具\n[ \u3000]*({JA_NAME})(?=\n|$)"), re.compile(rf"(?<![一-鿿])({JA_NAME})(?=様[、。宛]|さん[、。]|氏[、。は])")]

_AT = r"[\[({<]\s?(?:at|AT|ät|@|arroba)\s?[\])}>]"
_DOT_AHEAD = r"(?=[\w-]+(?:\.[\w-]+)*\s?(?:[\[({<]\s?|\s)(?:dot|DOT|punkt|point|punto)\b)"
_EMAIL = re.compile(rf"(?<![\w.+-])[\w][\w.+'-]{{0,63}}(?: ?@ ?|\s?{_AT}\s?| (?:AT|at) {_DOT_AHEAD})[\w-]+(?:(?:\.|\s?[\[({{<]\s?(?:dot|DOT|punkt|point|punto|\.)\s?[\])}}>]\s?| (?:dot|DOT|punkt|point|punto) )[\w-]+)+", re.A)
# one of them, or "@", is in every match of _EMAIL
_EMAIL_CUES = [re.compile(_AT, re.A), re.compile(f" at {_DOT_AHEAD}", re.A), re.compile(f" AT {_DOT_AHEAD}", re.A)]
_POINT = re.compile(r"(\S+) (?:AT|at) (\S+) point (?:\S+ )*?(?:\S*\.)?([A-Za-z]+)$")
# English words before "point" in prose, and ends of addresses beside those of two letters.
BEFORE_POINT = frozenset("""a an the this that these those some any one no each every what which whichever another either certain later earlier present
current given same starting turning tipping inflection price data entry exit end focal low lowest lower high highest higher mid middle midway midpoint half halfway
break breaking boiling melting freezing percentage basis selling access check single first second third last final our its their his her your my""".split())
WORDS2 = frozenset("am an as at be by do go he if in is it me my no of on or so to up us we".split())
DOMAINS = frozenset("com org net edu gov mil int info biz name pro coop example test invalid local app dev cloud online site shop bank tech".split())
_NUMBER = re.compile(r"(?<![A-Za-z0-9_.,$€£¥])(?:[(（]\+?\d{1,4}[)）][ -]?|\+)?\d(?:[ \u00a0]?[()（）./‐-–-]?[ \u00a0]?\d){6,18}(?:,? ?(?:ext|x|extension|Durchwahl|App|poste|ext\.|内線|转)\.? ?\d{1,5})?(?![A-Za-z0-9_%]|[.,]\d)", re.I)
_PHONE_FORMS = re.compile(
    r"\+\d{1,3}[ .\u00a0-]?(?:\(0\)[ ]?)?\(?\d.*|00(?:1|3\d|4\d|81|86|[2-9]\d)[ .-]?\d.*|[(（]\+\d{1,3}[)）][ -]?\d.*|(?:1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:1[ .-])?\d{3}([.-])\d{3}\1\d{4}|\d{3}/\d{3}-\d{4}|(?:1 )?\d{3} \d{3} \d{4}|[2-9]\d{9}"
    r"|[(（]0\d{1,4}[)）] ?\d{2,4}-?\d{3,4}|0\d{1,4}-\d{2,4}-\d{4}|0\d{2,4}[/ ]\d{3,8}(?:[ -]\d{1,5})?|0\d([ .-])\d\d(?:\2\d\d){3}|020 \d{4} \d{4}|0\d{2}([ -])\d{2,3}(?:\3\d{2,3}){1,2}|1\d{2}-\d{4}-\d{4}"
)
_PHONE_CUE = re.compile(r"(?:tel|telefon|téléphone|teléfono|phone|mobile|mobil|cell|fax|call|ring|reach(?:ed)?|number is|word at|gave|back on|joignable au|llamar|al|au|unter|电话|手机|致电|传真|電話|携帯|ファックス|tél|móvil|whatsapp|portable|handy)\W{0,14}(?:\w+ at )?$", re.I)
_NOT_PHONE = re.compile(r"(?:number|numbers|part|account|invoice|order|orders|ranges|file|cusip|isin|lot|ref|reference|no\.?|nr\.?|identification|code|ledger|id|ssn|passport|licence|license|security|insurance|steuer-id|ausweisnummer|sociale|dni|nie|nif|身份证号?|护照号?|マイナンバー|usd|\$|€|page|serial|batch|docket|ticket|case|policy|contract|from|to|rechnung|konto|vertrag|aktenzeichen|facture|compte|factura|cuenta|发票|账号|账户|訂單|注文)\W{0,4}$", re.I)
# Labels of official personal numbers and the forms that follow them.
_ID = re.compile(
    r"(?:\bSSN|\bsocial[ -]security(?: (?:number|no\.?|#))?|\btax(?:payer)? id(?:entification)?(?: (?:number|no\.?))?|\b(?-i:TIN)|\bITIN|\bpassport(?: (?:number|no\.?|#))?|\bnational insurance(?: (?:number|no\.?))?|\bNI (?:number|no\.?)|\bNINO|\bdriver['’]?s?['’]? licen[cs]e(?: (?:number|no\.?))?|\b(?:national )?(?:id|identity)(?: card)? (?:number|no\.?)|\bid card(?: (?:number|no\.?))?|\bID no\.?"
    r"|\bAusweisnummer|\bPersonalausweis(?:nummer| Nr\.?)?|\bReisepass(?:nummer| Nr\.?)?|\bSteuer-?ID(?:entifikationsnummer)?|\bSteueridentifikationsnummer|\bSozialversicherungsnummer|\bFührerschein(?:nummer)?"
    r"|\bnuméro de sécurité sociale|\bn° de sécurité sociale|\bsécurité sociale|\bn° de passeport|\bpasseport(?: n°)?|\bnuméro fiscal|\bcarte d['’]identité(?: n°)?"
    r"|\bCPF|\bAadhaar(?: (?:number|no\.?))?|\bPESEL|\bBSN|\bcodice fiscale|\bNRIC|\bEmirates ID|\bNHS (?:number|no\.?)|\bsocial insurance (?:number|no\.?)|\bpassaporto(?: n\.?)?|\bcarta d['’]identità|\bпаспорт\w*|\bИНН|\bСНИЛС"
    r"|\bDNI|\bNIE|\bNIF|\bpasaporte(?: n\.?º)?|\bnúmero de (?:pasaporte|identidad|la seguridad social)|\bdocumento de identidad"
    r"|身份证(?:号码|号)?|护照(?:号码|号)?|社保号|マイナンバー|個人番号|旅券番号|パスポート番号|運転免許証番号|免許証番号)"
    r"(?:\s*[:：#]\s*|\s+(?:is|was|ist|lautet|est|es|no\.?|number|Nr\.?|n°)?:?\s*|は|为|是)?"
    r"([A-Z]{0,3}[ -]?\d[\dA-ZÑ]*(?:[ .\u00a0-]?[\dA-ZÑ]{1,9})*(?:[ .-][A-ZÑ])?)(?![A-Za-z0-9_])",
    re.I,
)
# How those labels begin, in small letters.
LABELS = """ssn|social security|social-security|taxpayer id|tax id|tin|itin|passport|national insurance|nino|ni no|ni number|driver|id card|id no|id number|identity|ausweisnummer|personalausweis|reisepass|steuer-id|steuerid|steueridentifikationsnummer|sozialversicherungsnummer|führerschein|sécurité sociale|n° de|passeport|numéro fiscal|carte d'identité|carte d’identité|cpf|aadhaar|pesel|bsn|codice fiscale|nric|emirates id|nhs n|social insurance n|passaporto|carta d'identità|carta d’identità|паспорт|инн|снилс|dni|nie|nif|pasaporte|número de|documento de identidad|身份证|护照|社保号|マイナンバー|個人番号|旅券番号|パスポート番号|運転免許証番号|免許証番号""".split("|")
_TOWN = rf"[{_UP}][{_LO}]+(?:(?:-| )(?:on|upon|in|under|by|le|la|sur|am|an der|bei|de|del)(?:-| ))?(?:-?[{_UP}][{_LO}]+)?(?: (?!QQ|ZZ)[{_UP}][{_LO}]+)?"
_POST = r"(?:[A-Z]{2} \d{5}(?:-\d{4})?|[A-Z]{1,2}\d[\dA-Z]? \d[A-Z]{2}|\d{5}|[A-Z]\d[A-Z] \d[A-Z]\d)"
_STREET = r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Terrace|Boulevard|Blvd\.?|Way|Place|Pl\.?|Square|Sq\.?|Crescent|Close|Parkway|Pkwy\.?|Highway|Hwy\.?|Row|Walk|Mews|Gardens|Grove|Hill|Alley|Circle|Cir\.?|Trail)"
_ADDR = [
    re.compile(rf"(?:(?:Flat|Apartment|Apt\.?|Unit|Suite|Room) \w{{1,5}},? )?(?<![\w-])\d{{1,5}}[A-Za-z]?(?:-\d{{1,5}})? (?:[NSEW]\.? )?(?:[{_UP}][\w'’.-]+ ){{1,3}}{_STREET}(?![\w])(?:,? (?:Apt\.?|Apartment|Flat|Suite|Ste\.?|Unit|Floor|#) ?\w{{1,5}})?(?:(?:,\s+|\s*\n\s*){_TOWN}(?:,? {_POST})?)?"),
    re.compile(rf"[{_UP}][\w.-]*(?:straße|strasse|str\.|allee|weg|gasse|platz|ring|damm|ufer|chaussee|steig|stieg|Straße|Allee|Weg|Platz|Gasse) \d{{1,4}} ?[a-z]?(?:,\s*|\s*\n\s*)(?:D-|A-|CH-)?\d{{4,5}} {_TOWN.replace('a-zß-öø-ÿœ', 'a-zß-öø-ÿœ')}"),
    re.compile(rf"\d{{1,4}}(?: ?(?:bis|ter|quater|[a-dA-D]))?,? (?:rue|avenue|av\.|bd|boulevard|place|impasse|allée|chemin|quai|cours|route|square|passage)(?: (?:de la|de l['’]|des|du|de|d['’]))? ?[{_UP}][\w'’-]+(?: [{_UP}][\w'’-]+)*(?:,\s*|\s*\n\s*)(?:F-)?\d{{5}} {_TOWN}"),
    re.compile(rf"(?:Calle|C/|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|Camino|Carretera|Ronda|Travesía|Glorieta) ?(?:de (?:la |los |las )?|del )?[{_UP}][\w'’-]+(?: [{_UP}][\w'’-]+)*,? (?:n\.?º ?)?\d{{1,4}}(?:, (?:\d{{1,2}}\.?[ºª°] ?[A-Z]?(?: (?:izda|dcha)\.?)?|bajo(?: [A-Z])?|ático|entresuelo|[A-Z]))?(?:,\s*|\s*\n\s*)\d{{5}} {_TOWN}"),
    re.compile(rf"(?:Via|Viale|Piazza|Piazzale|Corso|Largo|Vicolo|Strada) (?:(?:del|della|dei|delle|degli|di|dell['’]|san|santa|sant['’]) ?)?[{_UP}][\w'’.-]+(?: [{_UP}][\w'’.-]+)*,? (?:n\.? ?)?\d{{1,4}}(?:/?[a-zA-Z])?(?:,\s*|\s*\n\s*)(?:I-)?\d{{5}} {_TOWN}(?: \(?[A-Z]{{2}}\)?)?"),
    re.compile(rf"(?:Rua|Avenida|Av\.|Travessa|Praça|Alameda|Largo) (?:(?:da|do|das|dos|de) )?[{_UP}][\w'’.-]+(?: (?:(?:da|do|das|dos|de|e) )?[{_UP}][\w'’.-]+)*,? (?:n\.?º ?)?\d{{1,5}}(?:,? ?(?:-|–)? ?(?:apto\.?|ap\.|sala|\d{{1,2}}\.?º)[^,\n]{{0,12}})?(?:(?:,| -| –)\s*[{_UP}][\w '’.-]{{2,30}})??(?:,\s*|\s*[-–]\s*|\s*\n\s*)(?:\d{{4,5}}-\d{{3}} {_TOWN}|{_TOWN}(?:\s*[-–/]\s*[A-Z]{{2}})?,? \d{{5}}-?\d{{3}})"),
    re.compile(rf"\d{{1,5}},? (?:rue|avenue|av\.|boul\.|boulevard|chemin|place) [{_UP}a-z][\w'’-]+(?: [{_UP}][\w'’-]+)*(?:,? (?:app\.|bureau|apt\.) ?\w{{1,5}})?(?:,\s*|\s*\n\s*){_TOWN},? \(?(?:QC|Québec|Quebec|ON|NB|MB|Ontario)\)?,? ?(?:[A-Z]\d[A-Z] ?\d[A-Z]\d)?"),
    re.compile(rf"[{_UP}][\w.-]*(?:straat|laan|weg|plein|gracht|kade|singel|dijk) \d{{1,4}}(?:[ -]?[a-zA-Z]|-\d{{1,3}})?(?:,\s*|\s*\n\s*)\d{{4}} ?[A-Z]{{2}} {_TOWN}"),
    re.compile(r"(?:(?<=[：:，,。\n于至在到住址 ])|^|(?<=寄往)|(?<=地址))(?:[一-鿿]{2,4}省)?[一-鿿]{2,4}市(?:[一-鿿]{1,4}[区县])?[一-鿿]{1,8}(?:大道|街道|街|路|巷|道|弄|胡同)\d{1,5}号(?:院)?(?:\d{1,4}(?:号楼|单元|栋|幢|楼|座))*(?:\d{1,5}[室号房])?"),
    re.compile(r"(?:〒?\d{3}-\d{4}[ \u3000]?)?(?<![一-鿿])[一-鿿々ヶケノ]{1,5}(?:都|道|府|県|市|区|郡)[一-鿿々ぁ-んァ-ヶ]{1,12}?(?:\d{1,3}丁目\d{1,3}番(?:地)?(?:\d{1,3}号)?|\d{1,3}(?:[-－‐−]\d{1,4}){1,3}|\d{1,4}番地?(?:\d{1,3}号)?)(?:[ \u3000]?[一-鿿ァ-ヶー]{2,10}\d{1,4}号室)?"),
]
# What each kind of address cannot do without, in small letters, and what stands behind it.
_ADDR_CUE = [
    ([f" {w.removesuffix(r'\.?').lower()}" for w in _STREET[3:-1].split("|")], re.compile(r"(?!\w)")),
    (["straße", "strasse", "str.", "allee", "weg", "gasse", "platz", "ring", "damm", "ufer", "chaussee", "steig", "stieg"], re.compile(r" \d")),
    ([" rue", " avenue", " av.", " bd", " boulevard", " place", " impasse", " allée", " chemin", " quai", " cours", " route", " square", " passage"], re.compile(rf" (?:[{_UP}]|d)|d|[{_UP}]")),
    (["calle", "c/", "avda", "avenida", "plaza", "pza", "paseo", "camino", "carretera", "ronda", "travesía", "glorieta"], re.compile("")),
    (["via ", "viale ", "piazza", "corso ", "largo ", "vicolo ", "strada "], re.compile("")),
    (["rua ", "avenida ", "av. ", "travessa ", "praça ", "alameda ", "largo "], re.compile("")),
    ([" rue", " avenue", " av.", " boul", " chemin", " place"], re.compile("")),
    (["straat", "laan", "weg", "plein", "gracht", "kade", "singel", "dijk"], re.compile(r" \d")),
    (["市"], re.compile("")),
    (["都", "道", "府", "県", "市", "区", "郡"], re.compile("")),
]
_BARE_STREET = re.compile(r"(?:at|to|of|in|address:?|for|lives at|parcel for|mailed to|moved to|jointly,)\s*$", re.I)
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_SIGNED = re.compile(rf"(?m)^[ \t]*({_REVERSED}|{_NAME})[ \t]*\n[ \t]*(?:Tel\.?|Tél\.?|Phone|Mobile|Mobil|Móvil)?:? ?[+(（\d][\d ()（）./+-]{{7,20}}[ \t]*$")
_SIGNED_CJK = re.compile(r"(?m)^[ \u3000]*(?:此致|敬具|敬上|谨上|拝具|草々)[ \u3000]*\n[ \u3000]*([一-鿿々ヶケヵノぁ-んァ-ヶ]{2,9}(?:[ \u3000][一-鿿ぁ-んァ-ヶ]{1,4})?)[ \u3000]*$")
_COLON = re.compile(r": (?=[A-Z])")

_GIVEN = {w.lower() for w in GIVEN_EN + GIVEN_DE + GIVEN_FR + GIVEN_ES}


def _automaton():
    a = ahocorasick.Automaton()
    for i, (lead, _) in enumerate(LEADS):
        a.add_word(lead, ("lead", i, lead))
    for t in TRAILS:
        if t not in a:
            a.add_word(t, ("trail", 0, t))
    for g in sorted(_GIVEN):
        a.add_word(g, ("given", 0, g))
    for t in ("mr. ", "mrs. ", "ms. ", "miss ", "dr. ", "prof. ", "herr ", "herrn ", "frau ", "mme ", "mlle ", "monsieur ", "madame ", "sra. ", "sr. ", "dña. ", "doña "):
        if t not in a:
            a.add_word(t, ("title", 0, t))
    a.make_automaton()
    return a


_FORWARD = [re.compile(rf"{_TITLES}({_REVERSED}|{_NAME})" + stop) for _, stop in LEADS]
_FORWARD_ANY = [re.compile(rf"{_TITLES}({_ANY}?)" + (stop or r"(?=[\n,.;:(/<]|$)"), re.I) for _, stop in LEADS]


class Finder:
    """Finds the personal data of a text; made once a task."""

    def __init__(self) -> None:
        self.triggers = _automaton()
        self.labels = ahocorasick.Automaton()
        of: dict[str, list] = {}
        for w in LABELS:
            of.setdefault(w, []).append(("label", w))
        for i, (cues, _) in enumerate(_ADDR_CUE):
            for w in cues:
                of.setdefault(w, []).append(("address", i))
        # what persons are and do opens the patterns for it
        for kind, words in (("role", ROLES), ("deed", DEEDS), ("by", DONE_BY)):
            for w in words:
                of.setdefault(f" {w}" if kind == "deed" else w, []).append((kind, w))
        for w, what in of.items():
            self.labels.add_word(w, what)
        self.labels.make_automaton()

    @staticmethod
    def _good(name: str, alone: bool = False) -> bool:
        words = [w for w in re.split(r"[ ,\u00a0]+", name) if w]
        if not words or len(name) < 2 or len(name) > 60 or len(words) > 5:
            return False
        long_ = [w for w in words if len(w.rstrip(".")) > 1]
        if not long_ or not alone and len(words) < 2:
            return False
        if any(w.strip(".").lower() in NOT_NAMES and len(w.strip(".")) > 1 and not (k and w.lower() in PARTICLES) for k, w in enumerate(words)):
            return False
        return not any(len(w.strip(".")) > 1 and w.strip(".").lower() in AFTER_NAME for w in words)

    @staticmethod
    def _firm(text: str, a: int, b: int) -> bool:
        """Whether the words around make a firm, brand or place of it."""
        m = re.match(r"[ \u00a0]?(?:&|[^\W_]+|,[ ](?:Inc|LLC|Ltd|LLP)\b)", text[b : b + 24])
        if m:
            w = m.group().strip(" ,\u00a0").lower()
            if w in AFTER_NAME and w not in ("and", "y", "e", "et", "und", "x", "one", "v") or w in ("v",) and text[b : b + 4].startswith(" v."):
                return True
        before = re.search(r"(\S+)[ \u00a0]$", text[max(0, a - 20) : a])
        return bool(before) and before.group(1).lower() in ("the", "&", "aunt", "uncle", "lot")

    @staticmethod
    def _prose(mail: str) -> bool:
        """Whether it is prose like "looked at this point in" and no address."""
        m = _POINT.search(mail)
        if not m:
            return False
        who, host, end = m.group(1), m.group(2).lower(), m.group(3).lower()
        return host in BEFORE_POINT or len(end) > 2 and end not in DOMAINS or end in WORDS2 and not re.search(r"[a-z].*[._+\d-]|[\d_].*[a-z]", who, re.I)

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Places and kinds, in order, without overlap."""
        if not text:
            return []
        found: list[tuple[int, int, str]] = []
        starts: list[int] = []  # of what is taken, in order, with the ends
        ends: list[int] = []

        def take(a: int, b: int, kind: str) -> None:
            k = bisect_left(ends, a + 1)  # the first that ends behind a
            if a < b and (k == len(starts) or starts[k] >= b):
                starts.insert(k, a)
                ends.insert(k, b)
                found.append((a, b, kind))

        if "@" in text or any(p.search(text) for p in _EMAIL_CUES):
            for m in _EMAIL.finditer(text):
                b = m.end()
                while text[b - 1] in ".-'_":
                    b -= 1
                if re.search(r"[A-Za-z]{2,}$", text[m.start() : b]) and not self._prose(text[m.start() : b]):
                    take(m.start(), b, "email")
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        labels, kinds, persons = [], set(), []
        for end, what in self.labels.iter(low):
            for kind, x in what:
                if kind == "label":
                    labels.append((end + 1 - len(x), x))
                elif kind != "address":
                    persons.append((kind, end + 1 - len(x) - (kind == "deed"), end + 1))
                elif x not in kinds and _ADDR_CUE[x][1].match(text, end + 1):
                    kinds.add(x)
        for start, word in labels:
            m = _ID.match(text, start)
            if not m:
                continue
            value = m.group(1)
            a, b = m.span(1)
            # a date or clause after the number is none of it
            value = re.match(r"[A-Z]{0,3}[ -]?\d[\dA-ZÑ]*(?:[ .\u00a0-]?(?:\d[\dA-ZÑ]*|[A-ZÑ](?![A-Za-z])|[A-Z]{2}(?=\d)))*", value)
            if not value:
                continue
            b = a + value.end()
            while text[b - 1] in " .-\u00a0":
                b -= 1
            if sum(c.isdigit() for c in text[a:b]) >= 6:
                while text[a] in " -":
                    a += 1
                take(a, b, "id_number")
        cjk = bool(_CJK.search(text))
        for i, pattern in enumerate(_ADDR):
            if i not in kinds or i >= len(_ADDR) - 2 and not cjk:
                continue
            for m in pattern.finditer(text):
                if i == 0:
                    before = text[max(0, m.start() - 24) : m.start()]
                    if re.search(r"\b(?:Lot|Build|No\.|Section|Note|Order|Part|Route)\s*$", before):
                        continue
                    whole = re.search(rf"(?:,\s+|\n\s*){_TOWN}(?:,? {_POST})?$", m.group())
                    if not whole and not _BARE_STREET.search(before):
                        continue
                b = m.end()
                take(m.start(), b - (text[b - 1] in ",;"), "address")
        for m in _NUMBER.finditer(text):
            self._phone(text, m, take)
        for m in _CPF.finditer(text) if _CPF_CUE in text else ():
            if _cpf(m.group()):
                take(*m.span(), "id_number")
        self._names(text, low, cjk, persons, take)
        found.sort()
        return found

    @staticmethod
    def _phone(text: str, m: re.Match, take) -> None:
        a, b = m.span()
        value = m.group()
        core = re.split(r",? ?(?:ext|x|extension|Durchwahl|App|poste|内線|转)\.? ?\d{1,5}$", value, flags=re.I)[0]
        digits = sum(c.isdigit() for c in core)
        if not 8 <= digits <= 15 or core.count("(") + core.count("（") != core.count(")") + core.count("）"):
            return
        before = text[max(0, a - 40) : a]
        if _NOT_PHONE.search(before) and not re.search(r"(?:number is|her number|his number|my number|daytime number)\W*$", before, re.I) or before.endswith("$"):
            return
        i, j = a, b
        while i and text[i - 1].isspace() and text[i - 1] != "\n":
            i -= 1
        while j < len(text) and text[j] in " .":
            j += 1
        alone = (not i or text[i - 1] == "\n") and (j == len(text) or text[j] == "\n")
        if _PHONE_FORMS.fullmatch(core) or (_PHONE_CUE.search(before) or alone and digits >= 9) and re.fullmatch(r"[\d ()（）./+\u00a0-]+", core):
            if re.fullmatch(r"\d{4}-\d{2}-\d{2}", core):
                return
            if re.fullmatch(r"\d{9,15}", core) and not (_PHONE_CUE.search(before) or alone or re.search(r"[,:]\s*$", before)):
                return
            take(a, b, "phone")

    def _names(self, text: str, low: str, cjk: bool, persons: list[tuple[str, int, int]], take) -> None:
        full: dict[str, None] = {}

        def add(a: int, b: int, alone: bool = False) -> bool:
            name = text[a:b]
            t = _strip_title.match(name)
            if t and t.end() < len(name) and (len(t.group().strip()) > 2 or " " in name[t.end() :]):
                a += t.end()  # a letter and a surname are an initial, not a title
                name = text[a:b]
            # a name ends where the next sentence or another name begins
            seen = 0
            for w in re.finditer(r"[^ \u00a0,]+", name):
                low_w = w.group().strip(".").lower()
                if seen and len(low_w) > 1 and (low_w in NOT_NAMES and low_w not in PARTICLES or seen >= 2 and "," not in name and low_w.split("-")[0] in _GIVEN and last not in _GIVEN):
                    b = a + len(name[: w.start()].rstrip(" \u00a0,"))
                    name = text[a:b]
                    break
                last, seen = low_w.split("-")[0], seen + 1
            while name and name[-1] in ",;:":
                b -= 1
                name = text[a:b]
            if name.endswith(".") and not re.search(r"(?:^|[ .-])[^\W\d_]\.$", name):
                b -= 1
                name = text[a:b]
            if not self._good(name, alone) or self._firm(text, a, b):
                return False
            take(a, b, "name")
            full[name] = None
            return True

        for end, (kind, i, word) in self.triggers.iter(low):
            start = end - len(word) + 1
            if kind in ("lead", "title", "given") and start and (low[start - 1].isalnum() or kind != "given" and low[start - 1] in "-'’"):
                continue
            if kind == "lead":
                m = _FORWARD[i].match(text, end + 1)
                single = word in ("dear ", "hi ", "hello ", "thank you, ", "thanks, ", "sehr geehrter ", "sehr geehrte ")
                if m and add(*m.span(1), alone=single and bool(m.start(1) > end + 1 or word in ("hi ", "hello "))):
                    self._second(text, word, m, add)
                elif not single and (m is None or not self._good(m.group(1))):
                    m = _FORWARD_ANY[i].match(text, end + 1)
                    if m and self._lower_name(m.group(1)) and add(*m.span(1)):
                        self._second(text, word, m, add)
            elif kind == "trail":
                seg_start = max(0, start - 64)
                seg = text[seg_start:start]
                if word == " <" and not re.match(r"[^<>\s]{1,64}(?:@| ?[\[({]| (?:AT|at) )", text[end + 1 : end + 80]):
                    continue
                if word.startswith(": "):
                    line = max(text.rfind(s, seg_start, start) for s in ("\n", ". ", "! ", "? "))
                    if line < 0 and seg_start:
                        continue
                m = _back.search(seg)
                if m and self._good(_strip_title.sub("", m.group(1))):
                    add(seg_start + m.start(1), start)
                else:
                    m = _back_any.search(seg)
                    if m and self._lower_name(m.group(1)):
                        add(seg_start + m.start(1), start)
            elif kind == "title":
                m = _full.match(text, end + 1)
                if m and text[start].isupper():
                    add(*m.span(1), alone=True)
                elif text[start].isupper():
                    m = _SMALL_NAME.match(text, end + 1)
                    if m and self._lower_name(m.group(1), 1):
                        add(*m.span(1), alone=True)
            elif kind == "given":
                if not text[start].isupper() or end + 1 < len(text) and text[end + 1].isalnum():
                    continue
                if start and text[start - 1] in "-@.+_<":
                    continue
                m = _full.match(text, start)
                if m:
                    name = m.group(1)
                    if "," in name:  # "Odette, Magnus" is a list of two
                        m = re.match(_NAME, text[start : start + 60])
                        name = m.group()
                    caps = name.isupper() and re.search(rf"[{_UP}]{{2}}\W*$", text[max(0, start - 3) : start])
                    if len(name.split()) >= 2 and not caps:
                        add(start, start + len(name))
                rev = re.search(rf"(?:^|[\s(:/–])({_TOK}), $", text[max(0, start - 30) : start])
                if rev and self._good(rev.group(1), True) and not self._firm(text, start, end + 1):
                    tail = re.match(rf"(?:-{_TOK})?(?: [{_UP}]\.)*", text[end + 1 : end + 30])
                    follows = text[end + 1 + tail.end() : end + 3 + tail.end()]
                    if re.match(r"[,.\n(/<:'’]|$| [a-z(/<]", follows):
                        add(max(0, start - 30) + rev.start(1), end + 1 + tail.end())
        for m in _SIGNED.finditer(text):
            add(*m.span(1))
        for m in _COLON.finditer(text):
            seg_start = max(0, m.start() - 64)
            n = _back.search(text[seg_start : m.start()])
            if n and any(w.strip(",").split("-")[0].lower() in _GIVEN for w in n.group(1).split()):
                a = seg_start + n.start(1)
                if not a or text[a - 1] == "\n" or text[max(0, a - 2) : a] in (". ", "! ", "? ", "\n "):
                    add(a, m.start())
        for kind, start, end in persons:
            if end < len(text) and (text[end].isalnum() or text[end] in "-_") or kind != "deed" and start and (text[start - 1].isalnum() or text[start - 1] in "-_"):
                continue
            if kind == "deed":
                at = max(0, start - 72)
                m = (_DOER if at else _DOER_FIRST).search(text[at:start])
            else:
                at, m = 0, (_ROLE if kind == "role" else _BY).match(text, end)
            if m:
                words = re.findall(r"[^\W_]+", m.group(1).lower())
                # a firm or a place may stand there as well
                if not any(w in AFTER_NAME or w in BEFORE_NAME or w in NOT_NAMES for w in words) and words[0] not in PLACES:
                    add(at + m.start(1), at + m.end(1))
        if not text.isascii() and _FAR.search(text):
            for pattern in _FAR_NAMES:
                for m in pattern.finditer(text):
                    take(*m.span(), "name")
                    full[m.group()] = None
        if cjk:
            self._cjk(text, take, full)
        self._again(text, full, take)

    @staticmethod
    def _lower_name(name: str, least: int = 2) -> bool:
        words = [w for w in re.split(r"[ ,\u00a0]+", name) if w]
        return least <= len(words) <= 5 and all(w.strip(".").lower() not in NOT_NAMES or k and w.lower() in PARTICLES for k, w in enumerate(words)) and not all(w[0].isupper() for w in words) or name.isupper() and least <= len(words) <= 5

    @staticmethod
    def _second(text: str, lead: str, m: re.Match, add) -> None:
        if lead == "returned by ":
            n = re.compile(rf" and ({_REVERSED}(?=, jointly)|{_NAME})").match(text, m.end(1))
            if n:
                add(*n.span(1))
                return
            n = re.compile(rf" and ({_ANY}?)(?=, jointly)").match(text, m.end(1))
            if n:
                add(*n.span(1))

    @staticmethod
    def _cjk(text: str, take, full: dict) -> None:
        for m in ZH_LEAD.finditer(text):
            n = ZH_NAME.match(text, m.end())
            if n:
                for b in (n.end(), n.end() - 1):
                    if b - n.start() >= 2 and ZH_AFTER.match(text, b):
                        take(n.start(), b, "name")
                        full[text[n.start() : b]] = None
                        break
        for m in _SIGNED_CJK.finditer(text):
            if len(m.group(1)) <= 9:
                take(*m.span(1), "name")
                full[m.group(1)] = None
        if re.search(r"[ぁ-ヿ]", text):
            for pattern in JA_CTX:
                for m in pattern.finditer(text):
                    take(*m.span(1), "name")
                    full[m.group(1)] = None
        for m in re.finditer(rf"((?:{'|'.join(SURNAMES_ZH2)})[一-鿿]{{1,2}}?)(?=先生|女士|[，（。、\n])", text):
            take(*m.span(1), "name")

    def _again(self, text: str, full: dict, take) -> None:
        """Further places of the names found, and surnames alone; one walk over the text finds them all."""
        lasts: dict[str, str] = {}
        for name in full:
            if _CJK.match(name) or "." == name[-1:]:
                continue
            words = name.split(",")[0].split() if "," in name else name.split()
            last = words[-1]
            if len(last) >= 4 and (len(words) >= 2 or "," in name) and last[0].isupper():
                lasts[name] = last
        wanted = {name for name in full if len(name) >= 4 or _CJK.match(name)} | set(lasts.values())
        if not wanted:
            return
        places: dict[str, list[int]] = {}
        walk = ahocorasick.Automaton()
        for w in wanted:
            walk.add_word(w, w)
        walk.make_automaton()
        for end, w in walk.iter(text):
            places.setdefault(w, []).append(end + 1 - len(w))
        for name in full:
            done = -1
            for at in places.get(name, ()) if name in wanted and (len(name) >= 4 or _CJK.match(name)) else ():
                b = at + len(name)
                if at < done:
                    continue
                done = b
                if (_CJK.match(name) or not (at and text[at - 1].isalnum()) and not (b < len(text) and text[b].isalnum())) and not self._firm(text, at, b):
                    take(at, b, "name")
            for at in places.get(lasts.get(name, ""), ()):
                b = at + len(lasts[name])
                before, after = text[at - 1] if at else " ", text[b : b + 2]
                if before.isalnum() or before in "_@.+-" or after[:1].isalnum() or after[:1] in "_@-" and after or after[:1] == "." and (after[1:].isalnum() or after[1:] == "_"):
                    continue
                if not self._firm(text, at, b) and text[max(0, at - 2) : at] != "& ":
                    # part of another full name stays with that name
                    if _PART_OF_NAME.search(text[max(0, at - 24) : at]) and not _ADDRESSED.search(text[max(0, at - 12) : at]):
                        continue
                    take(at, b, "name")


_CPF, _CPF_CUE = re.compile(r"(?<![\d.-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\d-])"), "-"


def _cpf(number: str) -> bool:
    """Whether the check digits of a Brazilian personal number are right."""
    d = [int(c) for c in number if c.isdigit()]
    for n in (9, 10):
        if sum(x * w for x, w in zip(d, range(n + 1, 1, -1))) * 10 % 11 % 10 != d[n]:
            return False
    return len(set(d)) > 1


_SYLLABLES = "ba be bi bo bu da de di do du fa fe fi fo ga ge go ha he hi ka ke ki ko la le li lo lu ma me mi mo mu na ne ni no pa pe pi po ra re ri ro ru sa se si so su ta te ti to tu va ve vi wa we zo".split()
_HAN = "安柏晨丹方谷和嘉景可兰明宁平清然山世松田文西向新秀雪雅阳一永远云泽正志中子"


# Letters of scripts, by which a made-up word keeps the script of the word it stands for; the vowels first.
ALPHABETS = ["аеиоуыэюя бвгджзклмнпрстфхцчшщ", "αεηιουω βγδζθκλμνξπρστφχψ", "אוי בגדהזחטכלמנסעפצקרשת", "اوي بتثجحخدذرزسشصضطظعغفقكلمنه", "अआइईउऊएओ कखगघचछजझटठडढतथदधनपफबभमयरलवशसह", "แเโไใ กขคงจชซญดตถทธนบปผพฟภมยรลวสหอ"]
_LETTER_OF = {c: (part, k) for k, line in enumerate(ALPHABETS) for part in line.split(" ") for c in part}
_HIRAGANA, _KATAKANA = "".join(map(chr, range(0x3042, 0x3094))), "".join(map(chr, range(0x30A2, 0x30F4)))
# Mail hosts of many people, which tell nothing about one, and labels that go with the last one of a host.
PUBLIC_HOSTS = frozenset("gmail googlemail yahoo outlook hotmail live icloud gmx web proton protonmail aol qq 163 126 orange free laposte t-online libero".split())
UPPER_LABELS = frozenset("co com org net ac gov edu".split())
_HOST_WORDS = frozenset("at dot punkt point punto arroba ät".split())


class Surrogates:
    """Keyed replacements. The same entity and key give the same replacement in any text; within a text none is given twice."""

    def __init__(self, key: bytes) -> None:
        self.key = key
        # given names of one gender and language in an order drawn by the key: each is replaced by the next, so that no two share one
        self.next: dict[str, str] = {}
        for pool in (GIVEN_EN, GIVEN_DE, GIVEN_FR, GIVEN_ES):
            for women in (True, False):
                names = sorted({g for g in pool if (g in FEMALE or g in FEMALE_OTHER) == women and g.casefold() not in self.next}, key=lambda g: hmac.new(key, f"order\x1f{g}".encode(), hashlib.sha256).digest())
                self.next.update((g.casefold(), names[(k + 1) % len(names)]) for k, g in enumerate(names))
        self.known: dict[tuple[str, int], str] = {}

    def _stream(self, kind: str, entity: str, turn: int):
        seed = hmac.new(self.key, f"{kind}\x1f{entity}\x1f{turn}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        block = 0
        while True:
            yield from hashlib.sha256(seed + block.to_bytes(4, "big")).digest()
            block += 1

    def _made(self, word: str, turn: int) -> str:
        """A made-up word in small letters, of the script of ``word``."""
        low = word.casefold()
        if (low, turn) in self.known:
            return self.known[low, turn]
        stream = self._stream("word", low, turn)
        if all(c < "ɐ" or not c.isalpha() for c in low):
            out = "".join(_SYLLABLES[next(stream) % len(_SYLLABLES)] for _ in range(3 + next(stream) % 2))
        else:
            out = "".join(self._letter(c, stream) for c in low)
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[low, turn] = out
        return out

    @staticmethod
    def _letter(c: str, stream) -> str:
        if _CJK.match(c) and not "぀" <= c <= "ヿ":
            return _HAN[next(stream) % len(_HAN)]
        if "぀" <= c <= "ゟ" or "゠" <= c <= "ヿ":
            pool = _HIRAGANA if c <= "ゟ" else _KATAKANA
            return pool[(next(stream) * 256 + next(stream)) % len(pool)]
        if "가" <= c <= "힣":
            return chr(0xAC00 + ((next(stream) * 256 + next(stream)) * 28) % 11172)
        part = _LETTER_OF.get(c)
        return part[0][next(stream) % len(part[0])] if part else c

    def word(self, word: str, turn: int = 0) -> str:
        """The replacement of a word of a name: same script and case, and for given names the same gender."""
        bare = word.rstrip(".")
        low = bare.casefold()
        if len(bare) == 1 and bare.isascii():
            return chr(ord("A" if bare.isupper() else "a") + (ord(low) - ord("a") + 1 + next(self._stream("letter", "", turn)) % 25) % 26) + word[1:]
        out = self.next[low] if low in self.next and not turn else self._made(bare, turn)
        if bare.isupper() and len(bare) > 1:
            out = out.upper()
        elif bare.islower():
            out = out.lower()
        elif bare[:1].isupper():
            out = out[:1].upper() + out[1:]
        return out + word[len(bare) :]

    def make(self, kind: str, mention: str, turn: int) -> str:
        if kind == "email":
            return self._email(mention, turn)
        stream = self._stream(kind, re.sub(r"\W", "", mention).casefold(), turn)
        if kind == "address":  # numbers and the name of the street change, words of form and the town stay
            if _CJK.search(mention):
                return re.sub(r"\d", lambda m: str(next(stream) % 9 + 1), re.sub(r"[一-鿿](?![一-鿿]{0,1}[市区県路街巷号])(?<![市区県路街巷号丁目番室单元])", lambda m: _HAN[next(stream) % len(_HAN)], mention))

            def swap(m):
                w = m.group()
                if w.isdigit():
                    return "".join(str(next(stream) % 9 + 1) for _ in w)
                if re.fullmatch(_STREET, w) or w in _FORM_WORDS or w.islower() and len(w) <= 9 or w.isupper():
                    return w
                tail = re.search(r"(?:straße|strasse|allee|weg|gasse|platz|str|straat|laan|plein|gracht)$", w)
                return self._made(w, turn).capitalize() + (tail.group() if tail else "")

            return re.sub(r"[^\W\d_]+|\d+", swap, mention)
        keep = re.match(r"[(（]?(?:\+|00)\d{1,2}", mention) if kind == "phone" else None
        head = keep.group() if keep else ""
        body = re.sub(r"\d", lambda m: str(next(stream) % 10), mention[len(head) :])
        return head + (re.sub(r"[A-Z]", lambda m: chr(65 + next(stream) % 26), body) if kind == "id_number" else body)

    def _email(self, mention: str, turn: int) -> str:
        """Words of the local part as words of names, so that an address follows its name; the host too, but for its ending."""
        local = re.match(r"[\w.+'-]*", mention).group()
        stream = self._stream("digits", mention.casefold(), turn)
        swap = lambda m: str(next(stream) % 10) if m.group().isdigit() else self.word(m.group(), turn)
        out = re.sub(r"[^\W\d_]+|\d", swap, local)
        labels = [m for m in re.finditer(r"[\w-]+", mention[len(local) :]) if m.group().lower() not in _HOST_WORDS]
        kept = 2 if len(labels) > 2 and labels[-2].group().lower() in UPPER_LABELS else 1
        host, at = mention[len(local) :], 0
        for m in labels[: max(0, len(labels) - kept)]:
            out += host[at : m.start()] + (m.group() if m.group().lower() in PUBLIC_HOSTS else self._made(m.group(), turn))
            at = m.end()
        return out + host[at:]

    def assign(self, mentions: dict[tuple[str, str], None]) -> dict[tuple[str, str], str]:
        """A replacement of each mention (kind, text) of one text.

        The first draw counts unless another word or mention of the text has it already; so it depends on the text only where
        two would fall together. An initial follows the name of the same surname that it can stand for.
        """
        words: dict[str, str] = {}
        owner: dict[str, str] = {}
        given: dict[tuple[str, str], str] = {}
        used: set[str] = set()
        names = [m for k, m in mentions if k == "name"]
        initials: dict[tuple[str, str], str] = {}  # of full names: surname and first letter, to the given name
        for name in names:
            parts = re.findall(r"[^\W\d_]+", name)
            if "," in name and len(parts) > 1:
                parts = [*parts[1:], parts[0]]
            for w in parts:
                low = w.casefold()
                if len(low) < 2 or low in words or low in PARTICLES:
                    continue
                turn, new = 0, self.word(low)
                while turn < 50 and (owner.get(new.casefold(), low) != low or new.casefold() == low):
                    turn += 1  # a word of letters that no alphabet here has stays as it is
                    new = self.word(low, turn)
                words[low], owner[new.casefold()] = new, low
            if len(parts) > 1 and len(parts[0]) > 1:
                initials.setdefault((parts[-1].casefold(), parts[0][0].casefold()), parts[0].casefold())

        def cased(w: str, new: str) -> str:
            return new.upper() if w.isupper() and len(w) > 1 else new.lower() if w.islower() else new[:1].upper() + new[1:]

        for kind, mention in mentions:
            if kind == "name":
                parts = re.findall(r"[^\W\d_]+", mention)
                last = (parts[0] if "," in mention else parts[-1]).casefold() if parts else ""

                def swap(m, last=last):
                    w = m.group()
                    low = w.casefold()
                    if low in PARTICLES:
                        return w
                    if len(low) == 1:
                        full = initials.get((last, low))
                        return cased(w, words[full][0]) if full in words else self.word(w)
                    return cased(w, words[low])

                given[kind, mention] = re.sub(r"[^\W\d_]+", swap, mention)
                continue
            turn, new = 0, self.make(kind, mention, 0)
            while turn < 50 and (new in used or new == mention and turn < 3):  # without a digit or letter to change it stays as it is
                turn += 1
                new = self.make(kind, mention, turn)
            given[kind, mention] = new
            used.add(new)
        return given

    def of(self, text: str, places: list[tuple[int, int, str]]) -> list[str]:
        """The replacement of each place."""
        given = self.assign(dict.fromkeys((kind, text[a:b]) for a, b, kind in places))
        return [given[kind, text[a:b]] for a, b, kind in places]

    def replace(self, text: str, places: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for (a, b, _), new in sorted(zip(places, self.of(text, places))):
            out += [text[at:a], new]
            at = b
        return "".join(out) + text[at:]


# Words of the form of an address.
_FORM_WORDS = frozenset("Flat Apt Apartment Unit Suite Room Floor Calle Avda Avenida Plaza Paseo Camino Carretera Ronda D F I A CH bis Via Viale Piazza Corso Largo Vicolo Strada Rua Travessa Praça Alameda".split())
PLACEHOLDER = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}


def with_placeholders(text: str, places: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in places:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join(out) + text[at:]


def _find(df: DataFrame, id_col: str, text_col: str, key: str | None, texts: bool) -> DataFrame:
    id_type = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def setup():
        finder, surrogates = Finder(), Surrogates(key.encode()) if key is not None else None

        def step(batch):
            places, masked, replaced = [], [], []
            for t in batch.column(1).to_pylist():
                p = finder.find(t) if t else []
                new = surrogates.of(t, p) if surrogates and p else [None] * len(p)
                places.append([{"kind": k, "start_pos": a, "end_pos": b, "mention": t[a:b], "surrogate": n} for (a, b, k), n in zip(p, new)])
                if texts:
                    masked.append(t if t is None else with_placeholders(t, p))
                    replaced.append(t if t is None else surrogates.replace(t, p) if surrogates else None)
            return [batch.column(0), places, masked, replaced] if texts else [batch.column(0), places]

        return step

    ddl = f"id {id_type}, places array<struct<kind:string,start_pos:int,end_pos:int,mention:string,surrogate:string>>"
    return map_batches(src, ddl + (", masked_text string, surrogate_text string" if texts else ""), setup)


def mentions(df: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every mention of personal data: the id, ``kind``, ``start_pos``, ``end_pos`` (end exclusive), ``mention``, and ``surrogate``, the
    keyed replacement that stands for it in this text as in all others (null without a ``key``).

    Null and empty texts and empty tables give no rows; rows given twice give their mentions twice, and a null id is
    kept. Places count code points. Only the id and the text are read, so other columns cannot clash.
    """
    found = _find(df, id_col, text_col, key, False)
    return found.select(F.col("id").alias(id_col), F.inline("places"))


def redact(df: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: the id, ``masked_text`` with a typed placeholder for each mention, ``surrogate_text`` (null
    without a ``key``) with keyed replacements, and ``mention_count``. A null text stays null."""
    found = _find(df, id_col, text_col, key, True)
    return found.select(F.col("id").alias(id_col), "masked_text", "surrogate_text", F.size("places").alias("mention_count"))
