"""Broken prompt and response pairs.

Copies: reply and question, word by word in codes of fixed width, are compressed with each other as a zstandard
dictionary. A word the dictionary does not hold costs its whole code, a run of words it holds next to nothing, so the
two sizes tell what either adds to the other; a reply that adds nothing and leaves little out is a copy. Languages and
refusals: dictionaries; a refusal is put together from a source, what it lacks and verbs of telling, or from a speaker
and what they cannot do. Truncation: a terminal-context model, trained on the table itself: how often the last words
before the break stand before an end of a sentence, elsewhere in all replies, and how often they go on.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.arrow import map_batches
from gleanery.session import cut

# Frequent small words of languages in Latin script.
SMALL = {
    "en": "the of and against over about into than more most after before between both each this these those there would could should may might can will shall been being other such only also under out up no not to in is was that for on with as by at from it its this which are were be has have had not or an a we our their they what who how why when did does do mostly came according says said since yes no",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man laut vom was allem vor seit ja nein wegen zwar",
    "fr": "le la les de des du un une et à en est que qui dans pour par sur au aux ce cette il elle ne pas plus se sa son ses leur selon nous vous avec ou sont été ont mais même depuis surtout dit soit oui non chez l d qu s",
    "es": "el la los las de del un una y a en es que por para con no se su sus al lo como más según sobre todo este esta entre desde hasta fue son ha han pero o ya muy qué indica sí tras",
    "pt": "o a os as de do da dos das um uma e em no na nos nas que por para com não se seu sua ao aos à mais como segundo sobre é foi são tem pelo pela contas desde entre também sim pesou",
    "it": "il lo la i gli le di del della dei delle dello un una e a in è che per con non si su da dal dalla nel nella sono ha hanno più come secondo anche riguarda soprattutto questo questa tra sì",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om hij ze door over ook als uit bij naar heeft hebben werd volgens vooral deze dit die jaar betreft tot nog wordt ja nee",
    "sv": "och i att det som en på är av för med till den har de inte om ett han var från så kan enligt gäller främst året eller vi man sig när ut under också",
    "da": "og i at det som en på er af for med til den har de ikke om et han var fra så kan ifølge gælder især året eller vi man sig når ud under også blev vedrører rapporten",
    "no": "og i at det som en på er av for med til den har de ikke om et han var fra så kan ifølge gjelder først fremst året eller vi man seg når ut under også ble rapporten særlig",
    "pl": "i w z na do nie się że to jest o jak za od po przez dla oraz ale są był była było według dotyczy głównie roku raportu sprawa ze przed co tym tak przy także",
    "cs": "a v z na do se že to je o jak za od po pro ale jsou byl byla bylo podle týká především roku zprávy ze před co tím tak při také není která který",
    "sk": "a v z na do sa že to je o ako za od po pre ale sú bol bola bolo podľa týka najmä roku správy zo pred čo tým tak pri tiež nie je ktorá ktorý",
    "ro": "și în de la cu pe din este a al ale că nu se un o pentru prin mai conform raportului privește anul sunt fost au care sau după către",
    "hu": "a az és hogy nem is egy van volt meg ez azt csak mint szerint jelentése elsősorban évet érinti vagy de már ha el között",
    "fi": "ja on ei se että oli hän ovat kuin mutta tai myös mukaan raportin koskee lähinnä vuotta vuoden joka sen ole vain",
    "tr": "ve bir bu da de için ile olarak daha çok gibi ne olan göre raporuna yılını yılı esas ilgilidir ilgili değil ancak en kadar sonra",
    "id": "dan yang di ke dari untuk dengan ini itu pada adalah dalam tidak akan oleh juga menurut laporan tahun terutama atau telah sebagai lebih karena",
    "vi": "và của là trong có được cho không với các một những này đã theo báo cáo năm chủ yếu về từ đến tại",
    "ca": "el la els les de del un una i a en és que per amb no es al dels segons sobretot informe afecta exercici sobre més aquest",
}
_WORDS_OF: dict[str, set[str]] = {}
for _lang, _list in SMALL.items():
    for _w in _list.split():
        _WORDS_OF.setdefault(_w, set()).add(_lang)
# Letters that point to a language in Latin script.
LETTERS = {"de": "äöüß", "fr": "éèêçàœâîô", "es": "ñ¿¡áéíóú", "pt": "ãõçáéíóúâê", "it": "àèìòù", "sv": "åäö", "da": "æøå", "no": "æøå", "pl": "łąęśżźćń", "cs": "ěščřžýůť", "sk": "ľĺŕčšžýťď", "ro": "șțăîâ", "hu": "őűáéíóöü", "fi": "äö", "tr": "ğışçöü", "vi": "ăđơưạảấầếềệọộớờợụứừ"}

# How a question names a language that it asks for.
NAMED = {
    "en": r"english|englisch|anglais|inglés|ingles|英语|英文|英語",
    "de": r"german|deutsch|allemand|alemán|aleman|德语|德文|ドイツ語",
    "fr": r"french|französisch|français|francais|francés|frances|法语|法文|フランス語",
    "es": r"spanish|spanisch|espagnol|español|espanol|西班牙语|西班牙文|スペイン語",
    "zh": r"chinese|chinesisch|chinois|chino|中文|汉语|中国語",
    "ja": r"japanese|japanisch|japonais|japonés|日语|日文|日本語",
    "pt": r"portuguese|portugiesisch|portugais|portugués|葡萄牙语|ポルトガル語",
    "it": r"italian|italienisch|italien\b|italiano|意大利语|イタリア語",
    "ko": r"korean|koreanisch|coréen|coreano|韩语|韓国語",
    "ru": r"russian|russisch|russe|ruso|俄语|ロシア語",
    "nl": r"dutch|niederländisch|néerlandais|neerlandés|荷兰语|オランダ語",
    "pl": r"polish|polnisch|polonais|polaco|波兰语|ポーランド語",
    "sv": r"swedish|schwedisch|suédois|sueco|瑞典语|スウェーデン語",
}
_NAMED = {k: re.compile(v, re.I) for k, v in NAMED.items()}
_ASKS = re.compile(r"\b(?:in|into|auf|ins|en|al|em)\s+\w|\b(?:language|sprache|langue|idioma)\b|term|wording|phrase|word|[用以で]|译|訳", re.I)

# Replies that stand for none.
PLACEHOLDERS = frozenset("n/a na n.a none null nil nan undefined tbd tba todo tbc placeholder empty blank pending answer antwort réponse reponse respuesta response reply 答案 回答 answer_here your_answer insert_answer lorem xxx none_given keine_antwort sans_réponse sin_respuesta 无 無し なし no_answer not_available string".split())

# What a reply draws on, what it may lack, and verbs of telling, by language.
_SRC = r"(?:passages?|excerpts?|contexts?|documents?|sources?|texts?|materials?|extracts?|snippets?|chunks?|results|pages|what (?:i was|i have been|was) (?:given|shown|provided))"
_TELL = r"(?:contain|mention|include|provide|cover|say|state|address|offer|give|discuss|specif(?:y|ie)|have|has|hold|allow|answer|support|disclose|reveal|show|tell|list|name|report|indicate|refer|describe|touch|deal|quantif(?:y|ie)|speak|hint|concern)"
_TOLD = r"(?:found|given|available|provided|contained|mentioned|stated|disclosed|included|specified|reported|shown|present|addressed|covered|answered|determined|inferred|established|named|listed|discussed|described|quantified|recoverable|derivable)"
_QUELLE = r"(?:auszüge[n]?|auszug|textstellen?|passagen?|kontext|unterlagen|dokumente?[ns]?|quellen?|texte?n?s?|abschnitte?n?|materialien|material)"
_EXTRAIT = r"(?:passages?|extraits?|contexte|documents?|sources?|textes?|éléments fournis|pièces)"
_PASAJE = r"(?:fragmentos?|pasajes?|extractos?|documentos?|textos?|contexto|fuentes?|material(?:es)?|páginas)"
_ZH = r"(?:资料|文档|段落|材料|上下文|原文|文本|片段|所给|提供的|摘录|文中)"
_JA = r"(?:資料|文書|抜粋|文脈|本文|コンテキスト|テキスト|原文|ご提示|提示された|与えられた)"

# Refusals, by language.
REFUSALS = [
    # the speaker cannot or will not
    r"\bi(?:['’]m| am)? (?:(?:really|simply|just|also|truly|afraid i) )?(?:cannot|can['’]?t|can not|won['’]t|will not|wouldn['’]t|couldn['’]t|could not|unable|not able|not allowed|not permitted|not in a position|in no position|not authori[sz]ed|must decline|have to decline|decline|refuse|would rather not|prefer not|don['’]t know|do not know|don['’]t have|do not have|have no|haven['’]t|lack|am not sure|was(?:n['’]t| not) able|was unable|found (?:no|nothing)|could find (?:no|nothing)|find (?:no|nothing)|see (?:no|nothing)|would need|need (?:more|further|additional)|(?:don['’]t|do not|cannot|can['’]t) see)\b",
    r"\bi (?:\w+ ){0,9}?(?:found|find|saw|see) (?:no|nothing|none)\b",
    r"\b(?:not possible|impossible|no way|beyond my|outside my) (?:for me )?(?:to|reach|scope|remit|knowledge|ability)?",
    r"\b(?:lies|is|falls|goes) (?:outside|beyond) (?:of )?(?:what i|my)\b",
    r"\bmy (?:instructions|guidelines|sources|training|knowledge|rules|policy|policies) (?:\w+ ){0,3}?(?:rule|forbid|stop|end|prevent|prohibit|do not|don['’]t|exclude)",
    r"\b(?:as an? (?:ai|language model)|sorry, (?:but )?no\b)",
    r"\b(?:please|could you|can you) (?:\w+ ){0,2}?(?:provide|share|supply|upload|send|paste) (?:\w+ ){0,3}?(?:" + _SRC + r"|section|filing|details|information|page|report)\b",
    # the passages hold nothing
    r"\b" + _SRC + r"\b[^.;]{0,40}\b(?:do(?:es)? not|doesn['’]t|don['’]t|did not|didn['’]t|fails? to|never) (?:\w+ )?" + _TELL,
    r"\b" + _SRC + r"\b[^.;]{0,30}\b(?:omits?|lacks?|leaves? (?:this |that |it )?out|(?:is|are|remains?|stays?|keeps?) (?:silent|mute|quiet)|says? nothing|makes? no|gives? (?:no|nothing)|offers? (?:no|nothing)|contains? (?:no|nothing)|holds? (?:no|nothing)|provides? (?:no|nothing)|sheds? no|(?:has|have) (?:no|nothing))\b",
    r"\b(?:none|nothing|no part|neither|nowhere) (?:of|in|from|among) (?:the |these |those |any |my )?(?:\w+ ){0,2}?" + _SRC + r"\b(?=[^.;]{0,30}\b" + _TELL + r"|[^.;]{0,12}$|[^.;]{0,25}\b(?:about|on|bears|helps|suffices)\b)",
    r"\b(?:nothing|nowhere) (?:\w+ ){0,3}?(?:in|among) (?:the |these |those )(?:\w+ )?" + _SRC,
    r"\b(?:chunks|passages|excerpts|documents|results|sources|snippets|context)\b (?:\w+ ){0,2}?(?:concern|relate to|are about|cover|deal with|refer to|is about|concerns|belong to) (?:\w+ ){0,2}?(?:another|different|other|unrelated)\b",
    r"\bno (?:answer|information|relevant \w+|mention|data|details?|evidence|passage|context|figure|number|indication|such \w+)\b[^.;]{0,40}\b(?:found|given|available|provided|contained|in the|could be|can be|is there|mentions?|covers?|about|on)\b",
    r"\b(?:unable|not able) to (?:comply|answer|respond|assist|help|say|determine|find)\b(?=[^.]{0,60}(?:$|[.]))",
    r"\b(?:not enough|insufficient|too little) (?:information|context|data|detail|material)\b",
    r"\b(?:cannot|can['’]?t|can not|could not|couldn['’]t) be (?:answered|determined|found|inferred|established|derived|told|worked out) (?:from|based|given|with|using|in|on)\b",
    r"\b(?:not|nowhere|never|n['’]t) (?:be )?(?:\w+ )?" + _TOLD + r"(?: \w+){0,2}? (?:in|by|within|from|among|anywhere in) (?:\w+ ){0,3}?" + _SRC,
    r"\b(?:unclear|not clear|not evident|hard to say|not apparent) (?:\w+ )?from (?:\w+ ){0,3}?" + _SRC,
    r"\banswer (?:is )?(?:not (?:found|available|given|known)|unavailable|unknown)\b",
    r"\b(?:information|answer|question) (?:is|was) not (?:available|provided|contained|given|in the)\b",
    r"\b(?:more|further|additional) (?:context|information|detail|material) (?:is|are|would be) (?:needed|required|necessary)\b",
    # German
    r"\b(?:kann|darf|möchte|werde|konnte|könnte) (?:ich )?(?:\w+ ){0,4}?(?:nicht|keine)\b", r"\bich (?:\w+ ){0,3}?(?:kann|darf|möchte|werde|konnte|weiß|habe|finde|sehe) (?:\w+ ){0,5}?(?:nicht|nichts|keine[nrsm]?)\b", r"\b(?:darf|kann) ich (?:mich )?(?:\w+ ){0,4}?(?:nicht|keine)\b",
    r"\b(?:lässt|lassen) sich (?:\w+ ){0,6}?nicht\b", r"\b(?:enthalten|enthält|liefern|bieten|geben|finde[nt]?|liegen) (?:\w+ ){0,4}?(?:keine?|nicht)\b[^.]{0,40}(?:angaben|information|hinweis|auskunft|zu |über|antwort|vor)", r"\bkeine (?:auskunft|antwort|angaben|informationen)\b", r"\btut mir leid\b", r"\bschweigen (?:dazu|sich|hierzu)\b", r"\bich (?:\w+ ){0,2}?lieber nicht\b", r"\bbin (?:ich )?(?:leider )?nicht in der lage\b", r"\bnicht (?:beantworten|beantwortet)\b", r"\bkeine[rs]? der (?:auszüge|textstellen|passagen)\b",
    r"\b" + _QUELLE + r"\b[^.;]{0,50}\b(?:nicht|nichts|nirgends|kein(?:e[nrsm]?)?)\b[^.;]{0,30}?\b(?:hervor\w*|ersichtlich|erwähn\w*|genannt|enthalten|angegeben|aufgeführt|beantwort\w*|festst\w*|ermitteln|bestimmen|entnehmen|finden|bekannt|angabe\w*|hinweis\w*|aussage\w*|antwort|information\w*|dazu|hierzu|darüber)",
    r"\b(?:nicht|nichts|nirgends|keine?)\b[^.;]{0,30}\b(?:in|aus|anhand|laut) (?:den|dem|der|diesen) (?:\w+ ){0,2}?" + _QUELLE + r"\b[^.;]{0,20}(?:$|[.])", r"\b(?:dazu|hierzu|darüber) (?:\w+ ){0,4}?(?:nichts|keine)\b", r"\b" + _QUELLE + r"\b (?:\w+ ){0,2}?schweig\w+",
    r"\b(?:nennen|nennt|enthalten|enthält|liefern|liefert|bieten|bietet|geben|gibt|machen|macht) (?:\w+ ){0,2}?" + _QUELLE + r"\b[^.;]{0,25}\b(?:kein(?:e[nrsm]?)?|nichts|nicht)\b", r"\b" + _QUELLE + r"\b[^.;]{0,40}\bkein(?:e[nrsm]?)? (?:\w+ )?(?:aufschluss|betrag|zahl|zahlen|wert|werte|datum|daten|name|namen)\b", r"\b" + _QUELLE + r"\b[^.;]{0,25}\b(?:offen|unklar|unbeantwortet)\b",
    # French
    r"\bje (?:ne |n['’])(?:\w+ )?(?:peux|puis|suis|saurais|sais|dispose|ai|trouve|souhaite|pourrai|vois)\b", r"\b(?:je suis )?désolée?\b", r"\baucune? (?:passage|extrait|information|réponse|document|source|élément|donnée|indication|mention)", r"\bne (?:permet|permettent|contient|contiennent|mentionne|mentionnent|fournit|fournissent|précise|précisent|traite|traitent|comporte|comportent|suffit|suffisent) (?:pas|aucun)", r"\bimpossible (?:de|pour moi)\b", r"\bpas en mesure\b", r"\bje préfère (?:ne pas|m['’]abstenir)\b", r"\b(?:muets?|silencieux|muettes?) (?:sur|à ce sujet)\b",
    r"\b" + _EXTRAIT + r"\b[^.;]{0,40}\bn(?:e |['’])\w+ (?:\w+ ){0,2}?(?:pas|rien|aucune?|nulle part)\b", r"\bn(?:e |['’])(?:\w+ ){1,3}?(?:pas|rien|nulle part)\b[^.;]{0,30}\b(?:dans|par|parmi) (?:les|le|ces|ce|l['’])\s?(?:\w+ )?" + _EXTRAIT,
    r"\brien (?:\w+ ){0,2}?(?:dans|parmi) (?:les|ces|le|l['’])\s?(?:\w+ )?" + _EXTRAIT,
    # Spanish
    r"\bno (?:me )?(?:puedo|podría|sé|dispongo|tengo|estoy en|soy capaz|es posible|cuento|encuentro|deseo|veo)\b", r"\blo siento\b", r"\blamento\b", r"\bprefier[oe] no\b", r"\b(?:me )?(?:resulta|es) imposible\b", r"\bning(?:ún|una|uno)\b[^.]{0,40}(?:fragmento|pasaje|extracto|documento|texto|información|fuente|dato)", r"\b" + _PASAJE + r"\b[^.;]{0,40}\bno (?:\w+ )?(?:contienen?|permiten?|mencionan?|incluyen?|ofrecen?|dicen?|tratan?|bastan?|aportan?|hablan?|indican?|especifican?|recogen?|figuran?|aparecen?|consta)", r"\bno (?:hay|se (?:puede|encontró|encuentra|dispone)) (?:\w+ ){0,3}?(?:información|respuesta|datos|responder)", r"\bno (?:\w+ ){0,2}?(?:figura|aparece|consta|menciona|indica|especifica|encuentra)\b[^.;]{0,30}\b(?:en|por) (?:los|las|el|la|estos) (?:\w+ )?" + _PASAJE, r"\bnada (?:\w+ ){0,3}?(?:en|sobre) (?:los|las|el|la|estos|ello|eso)\b",
]
# Refusals in Chinese and Japanese.
REFUSALS_WIDE = [
    r"抱歉|对不起|无法(?:回答|提供|确定|判断|给出|得知|答复|找到|处理|协助)|不能(?:回答|判断|提供|确定|给出|得知|答复|透露)|没有(?:关于|提及|提到|包含|相关|足够|任何)|未(?:提及|提到|提供|包含|找到|涉及)|找不到|不便(?:回答|透露)|不清楚|不知道|恕(?:我)?(?:无法|不能)|查无|无从(?:得知|判断|回答|知晓)|不足以(?:回答|判断|得出)",
    _ZH + r"(?:(?!显示|表明|指出|称|说|写|记载|提到)[^。；，,]){0,12}(?:并未|没有|没|并无|缺乏|不含|不包含|看不出)",
    r"お答え(?:でき|いたしかね|しかね)|答えられません|コメント(?:を|は)(?:控え|差し控え)|(?:差し)?控え(?:ます|させ)|回答(?:でき|いたしかね|しかね|を(?:控え|差し控え))|情報(?:が|は)(?:ありません|ない|含まれ|見当たり|不足)|判断(?:でき|し(?:かね|兼ね))|(?:分|わ)かりません|わかりかね|申し訳(?:あり|ござい)ません|記載(?:が|は)(?:ありません|ない)|含まれて(?:いません|おりません)|言及(?:が|は)?(?:ありません|されていません|していません)|見つかりません|見当たりません|できかねます|触れ(?:て|られて)いません|控えさせて",
    _JA + r"[^。；]{0,25}(?:ありません|読み取れ|書かれていません|示されていません|不明です|得られません|特定できません|ございません)",
]
_REFUSAL = re.compile("|".join(f"(?:{x})" for x in REFUSALS), re.I)
_REFUSAL_WIDE = re.compile("|".join(f"(?:{x})" for x in REFUSALS_WIDE))
# Words of which every refusal in Latin script has one ("t" and "n" are what an apostrophe leaves of them).
HINTS = frozenset("""not cannot cant t no nothing none neither nowhere never unable impossible unclear hard sorry decline refuse omit omits lack lacks
leave leaves silent mute quiet fail fails beyond outside my ai language please could can insufficient little other another different unrelated need needed
required necessary unavailable unknown nicht nichts nirgends kein keine keinen keiner keines keinem leid schweigen schweigt offen unklar unbeantwortet rien ne n désolé désolée aucun aucune
impossible pas préfère muet muets muette muettes silencieux siento lamento prefiero prefiere imposible ningún ninguna ninguno nada""".split())

# Words that go with repeating a question.
ECHO = frozenset("""question questions q a answer you asked ask asking the is was your my this that following here again repeat repeated user query prompt
frage die lautet ihre sie haben gefragt war lautete vous avez demandé votre est la de pregunta su usted preguntó es ha preguntado preguntaste
问 题 是 您 的 你 問 質 は 次 で す ご 回 答""".split())

_TAG = re.compile(r"<[^<>]*>")
_CITE = re.compile(r"\[\s*\d{1,3}(?:\s*[,;–-]\s*\d{1,3})*\s*\]|[¹²³⁰⁴⁵⁶⁷⁸⁹]+|【\d{1,3}】|\[\^\d{1,3}\]")
_MARKUP = re.compile(r"```\w*|[*_`#>|~]+|&(?:nbsp|amp|lt|gt|quot);")
_QUOTED = re.compile(r"“[^“”]+”|„[^„“”]+[“”]|«[^«»]+»|「[^「」]+」|『[^『』]+』|(?<!\w)\"[^\"]+\"(?!\w)")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
_UNIT = re.compile(r"[぀-ヿ㐀-䶿一-鿿]|[^\W_]+(?:['’][^\W_]+)*")
_PIECE = re.compile(r"[぀-ヿ㐀-䶿一-鿿]|(?:(?![぀-ヿ㐀-䶿一-鿿])[^\W_])+")
_LATIN = r"(?:(?![぀-ヿ㐀-䶿一-鿿])[^\W\d_])+"
_TOKEN = re.compile(rf"\[\d{{1,3}}\]|\n+|[$€£¥]?\d[\d.,]*\d|\d|[぀-ヿ㐀-䶿一-鿿]|{_LATIN}(?:['’-]{_LATIN})*|[^\w\s]")
_LABEL = re.compile(r"^\s*(?:\**\s*(?:answer|antwort|réponse|respuesta|response|reply|a|回答|答案|答)\s*\**\s*[:：]\s*\**|sure[.!,]|based on the passages,)\s*", re.I)
_STOP = ".!?。！？…؟।"
_CLOSE = "\"”“’»」』)）*_`  ​"


# invisible and control characters, but for line breaks and tabs
_INVISIBLE = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x10000) if unicodedata.category(chr(c)) in ("Cf", "Cc") and chr(c) not in "\n\t") + "\U000e0001-\U000e007f]")
_WORDS = re.compile(r"[^\W\d_]+")


def plain(text: str) -> str:
    """The text without tags, markup, citation marks and invisible characters."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _CITE.sub(" ", text)
    text = _MARKUP.sub(" ", text)
    return _INVISIBLE.sub("", text).strip()


def is_empty(answer: str | None, left: str | None = None) -> bool:
    """``left``: the plain text, where it is known."""
    if answer is None or not answer.strip():
        return True
    left = plain(answer) if left is None else left
    if len(left) > 60:
        return False  # longer than any placeholder
    bare = re.sub(r"[^\w/.]+", "_", left.lower()).strip("_.")
    if not any(map(str.isalnum, left)):
        return True
    if bare in PLACEHOLDERS:
        return left != "None." and not (bare in ("none", "na") and left.endswith("."))
    return bool(re.fullmatch(r"(?:answer|antwort|réponse|respuesta|response|reply|回答|答案)\s*[:：]?", left.strip(), re.I)) or bool(re.fullmatch(r"[\[<({]+\s*(?:insert|your|the|an?)?\s*(?:answer|response|text|reply|empty|placeholder|missing)[^\]>)}]{0,20}[\]>)}]+", answer.strip(), re.I))


#: Bytes that stand for a word when replies and questions are compressed with each other; and what a question may be cut by.
CODE, LEFT_OUT = 16, 0.15
_SMALL_WINDOW = zstandard.ZstdCompressionParameters(window_log=14, hash_log=10, chain_log=10, search_log=3, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)


def coded(words: list[str]) -> bytes:
    """Words in codes of ``CODE`` bytes that no two words have in common."""
    return b"".join(xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")) for w in words)


def cost(text: bytes, dictionary: bytes) -> int:
    """Bytes of ``text`` compressed with a raw dictionary."""
    known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(compression_params=_SMALL_WINDOW, dict_data=known).compress(text))


def is_copy(question: str | None, answer: str, left: str | None = None) -> bool:
    """Whether the reply only repeats the question: compressed with the question as dictionary it costs less than one more word
    than the question itself does, and with the reply as dictionary the question costs no more than what may be left out.

    Words that go with repeating are passed over on both sides.
    """
    if not question or not question.strip():
        return False
    in_q = [w for w in _PIECE.findall(plain(question).lower()) if w not in ECHO]
    in_a = [w for w in _PIECE.findall((plain(answer) if left is None else left).lower()) if w not in ECHO]
    # two words that the question lacks cost two codes, so that nothing is left to compress
    if not in_q or not in_a or len(in_a) > 6 * len(in_q) or len(set(in_a).difference(in_q)) > 1:
        return False
    q, a = coded(in_q), coded(in_a)
    same = cost(q, q)
    return cost(a, q) < same + CODE and cost(q, a) < same + CODE * (0.5 + LEFT_OUT * len(in_q))


_SCRIPTS = {k: re.compile(v) for k, v in {"kana": "[぀-ヿ]", "zh": "[㐀-䶿一-鿿]", "ko": "[가-힯]", "ru": "[Ѐ-ӿ]", "ar": "[؀-ۿ]", "th": "[฀-๿]", "hi": "[ऀ-ॿ]", "el": "[Ͱ-Ͽ]", "he": "[֐-׿]"}.items()}
_FAR = re.compile("[Ͱ-\U0001ffff]")
_MARKS: dict[str, tuple[str, ...]] = {}
for _lang, _list in LETTERS.items():
    for _c in set(_list):
        _MARKS[_c] = (*_MARKS.get(_c, ()), _lang)


class Spoken:
    """What a text tells of its language: ``lang`` and how ``sure`` that is ('' where nothing tells), and the languages whose small
    words explain it almost as well as those of the best (``plausible``)."""

    __slots__ = ("lang", "sure", "plausible")

    def __init__(self, text: str) -> None:
        self.plausible: set[str] = set()
        if not text.isascii() and _FAR.search(text):
            n = {k: len(p.findall(text)) for k, p in _SCRIPTS.items()}
            kana = n.pop("kana")
            n["ja"], n["zh"] = kana + (n["zh"] if kana else 0), 0 if kana else n["zh"]
            best = max(n, key=lambda k: n[k])
            latin = sum(map(len, _WORDS.findall(text))) - sum(n.values()) if n[best] else 0
            if n[best] * 3 >= latin and n[best] >= 2 or n[best] >= 6 and n[best] * 8 >= latin:
                self.lang, self.sure = best, float(n[best])
                return
        low = text.lower()
        score: dict[str, float] = {}
        count: dict[str, int] = {}
        for w in _WORDS.findall(low):
            of = _WORDS_OF.get(w)
            if of:
                part = len(of) ** -0.5
                for lang in of:
                    score[lang] = score.get(lang, 0) + part
                    count[lang] = count.get(lang, 0) + 1
        if not score:
            self.lang, self.sure = "", 0.0
            return
        if not low.isascii():
            marks = Counter(lang for c in low if c > "\x7f" for lang in _MARKS.get(c, ()))
            for lang in score:
                score[lang] += 0.3 * min(4, marks[lang])
        most = max(count.values())
        self.plausible = {k for k, v in count.items() if v >= 0.75 * most}
        self.lang = max(score, key=lambda k: score[k])
        self.sure = score[self.lang]


_QUOTES = re.compile("[“”„«»「」『』\"]")


def unquoted(text: str) -> str:
    """The text without what stands in quotation marks, however long."""
    return _QUOTED.sub(" ", text) if _QUOTES.search(text) else text


def is_other_language(question: str | None, answer: str, left: str | None = None) -> bool:
    if not question:
        return False
    bare = unquoted(_LABEL.sub("", plain(answer) if left is None else left))
    said = Spoken(bare)
    if not said.lang or said.sure < 1:
        return False
    asked = Spoken(unquoted(plain(question)))
    if not asked.lang or said.lang == asked.lang:
        return False
    if len(_UNIT.findall(bare)) < 3:
        return False
    # a language of the question may fit the reply just as well
    if asked.lang in SMALL and said.lang in SMALL and asked.plausible & said.plausible:
        return False
    return not (said.lang in _NAMED and _NAMED[said.lang].search(question) and _ASKS.search(question))


# What may stand before a refusal that a filing or a firm tells of itself.
_TELLER = re.compile(r"\b(?:states?|stated|says?|said|reports?|reported|warns?|adds?|notes?|noted|believes?|expects?|it|they|management|company|he|she|who)\s+(?:that\s+)?(?:it\s+|they\s+|he\s+|she\s+)?(?:is\s+|are\s+|was\s+|were\s+)?$", re.I)
_ME = re.compile(r"\b(?:i|me|my)\b", re.I)
# what a reply says of its sources it says for itself
_SOURCE = re.compile(r"\b" + _SRC + r"\b", re.I)


def is_refusal(answer: str, left: str | None = None) -> bool:
    text = _LABEL.sub("", plain(answer) if left is None else left).strip()
    latin = not HINTS.isdisjoint(_WORDS.findall(text.lower()))
    wide = not text.isascii() and _CJK.search(text) is not None
    if not latin and not wide:
        return False
    whole = re.fullmatch(r"[\"“„«](.*)[\"”“»]", text, re.S)
    if whole and not re.search(r"[\"”“»]", whole.group(1)):
        text = whole.group(1)
    text = unquoted(text)
    for pattern in [_REFUSAL] * latin + [_REFUSAL_WIDE] * wide:
        # what a filing or a firm says of itself is a reply; sentences that open so are passed over
        for m in pattern.finditer(text):
            start = max(text.rfind(s, 0, m.start()) for s in (". ", "! ", "? ", "。", "\n"))
            if _ME.search(m.group()) or _SOURCE.search(m.group()) or not _TELLER.search(text[start + 1 : m.start()]):
                return True
    return False


def _tokens(text: str) -> list[str]:
    """Words in lower case; numbers, names and citation marks stand for their kind; line breaks are tokens."""
    out, start = [], True
    found = _TOKEN.findall(re.sub(r"\.{2,}", "…", text))
    for t, follows in zip(found, [*found[1:], ""]):
        if t[0] == "[" and len(t) > 2:
            out.append("[0]")
        elif t[0].isdigit() or len(t) > 1 and t[1].isdigit():
            out.append("0")
            start = False
        elif t[0] == "\n":
            out.append("\n")
            start = True
        elif t[0].isalpha():
            # a capital opens a sentence or a name; two in a row are a name
            name = t[0].isupper() and len(t) > 1 and (not start or follows[:1].isupper())
            out.append("N" if name else t.lower())
            start = False
        else:
            out.append(t)
            if t in _STOP:
                start = True
    return out


_MASK = (1 << 64) - 1
_FOLD = 0x9E3779B97F4A7C15
_SEED = 0x2545F4914F6CDD1D


class _Codes(dict):
    """Codes of tokens, made when first asked for."""

    def __missing__(self, token: str) -> int:
        self[token] = h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


_CODES = _Codes()


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _key(parts: list[str]) -> int:
    """A hash of tokens in order, built up token by token."""
    h = _SEED
    for t in parts:
        h = (h ^ _CODES[t]) * _FOLD & _MASK
        h ^= h >> 29
    return _signed(h)


def _folded(h: np.ndarray | np.uint64, codes: np.ndarray) -> np.ndarray:
    """The same for many at once: each hash with one more token."""
    h = (h ^ codes) * np.uint64(_FOLD)
    return h ^ (h >> np.uint64(29))


#: Words of a context, and the fewest occurrences from which its counts are trusted.
CONTEXT, TRUST, SHORT = 3, 4, 9
#: Share below which a way to go on from the beginning of a reply is rare.
RARE = 0.02


# Replies of one word, and small words within names.
WORDS = frozenset("yes no ja nein doch oui non si sí 是 否 不 はい いいえ true false".split())
JOINTS = frozenset("& + of the and for in on de la le les du des von van der den und et y e del los las".split())
_QUANTITY = re.compile(r"(?:[A-Z]{3} ?|[$€£¥] ?|US\$ ?)?[+-]?\d[\d.,]*(?: ?(?:[A-Z]{3}|[%€$£¥]|(?:hundred|thousand|million|billion|trillion|percent|per cent|Prozent|Tausend|Million(?:en)?|Milliarden?|Mio|Mrd|pour cent|mille|millions|milliards?|por ciento|mil|mill[oó]n(?:es)?|dollars?|euros?|yen|yuan)\b|[十百千万亿億兆]+|美元|欧元|日元|人民币|元|円|ドル|ユーロ))*")


def _bare_name(text: str) -> bool:
    """Whether it is all words with capitals, numbers and what joins them, as a name that is a reply."""
    words = text.split()
    return bool(words) and words[0][0].isupper() and words[-1] not in JOINTS and all(w[0].isupper() or w[0].isdigit() or w in JOINTS for w in words)


def _body(answer: str) -> tuple[list[str], list[str]]:
    """The tokens of a reply, and those before its last stops and citation marks."""
    toks = ["\x02", *_tokens(answer.rstrip(_CLOSE + "\n"))]
    body = toks
    while len(body) > 1 and (body[-1] in _STOP or body[-1] == "[0]" or body[-1] == "\n"):
        body = body[:-1]
    return toks, body


def contexts(answers: list[str], times: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each context in replies: its key, how often it stood before an end of a sentence or line, and how often it went on.

    ``times``: rows with each reply; as a whole reply, and the beginning of one, a reply counts once.
    """
    if len(_CODES) > 1_000_000:
        _CODES.clear()
    bodies = [_body(a) for a in answers]
    lengths = np.array([len(toks) for toks, _ in bodies])
    flat = [t for toks, _ in bodies for t in toks]
    codes = np.fromiter(map(_CODES.__getitem__, flat), np.uint64, len(flat))
    stop = np.fromiter((t in _STOP or t == "\n" for t in flat), bool, len(flat))
    dots = codes == np.uint64(_CODES["…"])
    first = np.zeros(len(flat), bool)
    begin = np.cumsum(lengths) - lengths
    first[begin] = True
    final = np.zeros(len(flat), bool)
    final[begin + lengths - 1] = True
    # an end: before a stop or a line break, or a citation mark as the last token; the word where a reply breaks off is neither
    closes = np.append(stop[1:], False) & ~final | final & (codes == np.uint64(_CODES["[0]"]))
    use = ~first & ~stop & ~(np.append(dots[1:], False) & ~final) & (~final | closes)
    weight = np.repeat(np.array(times, np.int64), lengths)
    at = np.arange(len(flat)) - np.repeat(begin, lengths)  # place within the reply
    keys, ends, on = [], [], []
    h = np.full(len(flat), _SEED, np.uint64)
    for k in range(1, CONTEXT + 1):
        h = _folded(np.concatenate([[np.uint64(_SEED)], h[:-1]]) if k > 1 else h, codes)
        good = use & (at >= k - 1)
        keys.append(h[good])
        ends.append(np.where(closes[good], weight[good], 0))
        on.append(np.where(closes[good], 0, weight[good]))
    # a short reply: how often all of it is a reply, and how often a longer one begins so
    size = np.array([len(body) for _, body in bodies])
    h = np.full(len(bodies), _folded(np.array([_SEED], np.uint64), np.uint64(_CODES["\x03"]))[0], np.uint64)
    for i in range(1, SHORT + 1):
        live = np.flatnonzero(size >= i)
        h[live] = _folded(h[live], codes[begin[live] + i - 1])
        if i > 1:
            whole = size[live] == i
            keys.append(h[live])
            ends.append(whole.astype(np.int64))
            on.append(np.where(whole, 0, 1))
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key.view(np.int64), np.bincount(inverse, np.concatenate(ends), len(key)).astype(np.int64), np.bincount(inverse, np.concatenate(on), len(key)).astype(np.int64)


def open_end(answer: str) -> tuple[str, list[int], bool]:
    """``cut`` or ``whole`` where the end itself tells; else ``ask`` with the contexts to look up.

    The flag tells whether the last word is of small letters, so that a fragment of a word may show as a word never seen.
    """
    text = _TAG.sub(" ", answer) if "<" in answer else answer
    text = _INVISIBLE.sub("", text).rstrip()
    bare = text.rstrip(_CLOSE)
    if not bare:
        return "whole", [], False
    if re.search(r"(?:^|\n)\s*(?:[-*•–]|\d{1,2}[.)])[\s*_`]*$", text) and "\n" in text.strip():
        return "cut", [], False
    if bare.endswith(("...", "…", "..")):
        return "cut", [], False
    if bare[-1] in _STOP:
        return "whole", [], False
    if bare[-1] in ",;:、，；：-–—(（[&/$€«„“「":
        return "cut", [], False
    if re.search(r"\[\d{0,3}$", bare):
        return "cut", [], False
    if bare[-1] == "]":
        return "whole", [], False
    if not any(map(str.isalpha, bare)):
        return "whole", [], False  # a number or a date alone
    if bare.strip().lower() in WORDS or _QUANTITY.fullmatch(bare.strip()):
        return "whole", [], False
    last_line = bare.rsplit("\n", 1)[-1]
    toks = ["\x02", *_tokens(bare)]
    if re.match(r"\s*(?:[-*•–]|\d{1,2}[.)])\s+\S", last_line) and len(last_line.split()) <= 8:
        return "whole" if last_line.strip()[-1].isalnum() else "cut", [], False
    keys = [_key(toks[max(0, len(toks) - k) :]) for k in range(CONTEXT, 0, -1)]
    whole = _key(["\x03", *toks]) if len(toks) <= SHORT else 0
    begun = _key(["\x03", *toks[:-1]]) if whole and len(toks) > 2 else 0
    return "ask", [whole, *keys, begun], toks[-1].isalpha() and toks[-1].islower() and len(toks) > 3


def defects(df: DataFrame, id_col: str = "result_id", question_col: str = "question", answer_col: str = "answer") -> DataFrame:
    """Defective rows: the id and ``defect``, one of ``empty``, ``copied_question``, ``refusal``, ``other_language``, ``truncated``.

    Kinds are tried in that order. A null or empty answer is ``empty``; with a null or empty question only ``empty``,
    ``refusal`` and ``truncated`` can be told. Rows with a null id take no part; rows equal in id, question and answer
    count once; if rows of one id differ, the first defect by the order above is given. Empty tables give no rows. Only
    the three columns are read, so other columns cannot clash.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.col(question_col).alias("q"), F.col(answer_col).alias("a")).where("id IS NOT NULL")

    def judge():
        def step(batch):
            kinds, keys, small, own, names = [], [], [], [], []
            for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ask, low = [], False
                left = plain(a) if a else ""
                if is_empty(a, left):
                    kind = "empty"
                elif is_copy(q, a, left):
                    kind = "copied_question"
                elif is_refusal(a, left):
                    kind = "refusal"
                elif is_other_language(q, a, left):
                    kind = "other_language"
                else:
                    kind, ask, low = open_end(a)
                    kind = {"cut": "truncated", "whole": ""}.get(kind, "?")
                kinds.append(kind)
                keys.append(ask)
                small.append(low)
                # whether the model counts this very reply as a whole one
                own.append(int(bool(ask) and ask[0] != 0 and ask[0] == _key(["\x03", *_body(a)[1]])))
                names.append(bool(ask) and _bare_name(_TAG.sub(" ", a).strip().rstrip(_CLOSE)))
            return [batch.column(0), kinds, keys, small, own, names]

        return step

    judged = cut(map_batches(src, f"id {id_type}, kind string, keys array<long>, small boolean, own int, name boolean", judge).where("kind <> ''"))

    def count():
        def step(batch):
            return [pa.array(x) for x in contexts(batch.column(0).to_pylist(), batch.column(1).to_pylist())]

        return step

    asked = judged.where("kind = '?'").select("id", "small", "own", "name", F.posexplode("keys").alias("level", "key")).where("key <> 0")
    model = map_batches(src.where("a IS NOT NULL").groupBy(F.trim("a").alias("a")).count(), "key long, ends long, on long", count).groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("on").alias("goes"))
    seen = asked.join(model, "key", "left").select("id", "small", "own", "name", "level", F.coalesce("ends", F.lit(0)).alias("ends"), F.coalesce("goes", F.lit(0)).alias("goes"))
    level = lambda n, c: F.max(F.when(F.col("level") == n, F.col(c)))
    per = seen.groupBy("id").agg(F.max("small").alias("small"), F.max("own").alias("own"), F.max("name").alias("name"), *[level(n, c).alias(f"{c}{n}") for n in range(CONTEXT + 2) for c in ("ends", "goes")])
    per = per.na.fill(0)
    share = lambda n: F.col(f"ends{n}") / (F.col(f"ends{n}") + F.col(f"goes{n}"))
    known = lambda n: F.col(f"ends{n}") + F.col(f"goes{n}") >= TRUST
    never = F.col("small") & (F.col(f"ends{CONTEXT}") + F.col(f"goes{CONTEXT}") < 2)
    # a short reply stands if other replies like it end there, and if its last word is not a rare turn of replies that begin alike
    others = F.greatest(F.col("ends0") - F.col("own"), F.lit(0))
    more = others >= F.col("goes0")
    usual = F.col("ends0") + F.col("goes0") >= RARE * F.col(f"goes{CONTEXT + 1}")
    closed = F.when(never, F.lit(0.0)).when((F.col("name") | (others >= TRUST)) & (F.col("ends0") > 0) & more & usual, F.lit(1.0))
    for n in range(1, CONTEXT):  # the longest trusted context; one word alone tells too little
        closed = closed.when(known(n), share(n))
    closed = closed.when(F.col(f"ends{CONTEXT - 1}") > 0, share(CONTEXT - 1))
    # nothing tells against a short reply that no other begins with, unless its last word is known and never stood at an end
    closed = closed.when((F.col("ends0") > 0) & more & usual & ((F.col(f"ends{CONTEXT}") > 0) | ~known(CONTEXT)), F.lit(1.0))
    cut_off = per.where(closed.otherwise(F.lit(0.0)) < 0.4).select("id", F.lit("truncated").alias("kind"))
    found = judged.where("kind <> '?'").select("id", "kind").union(cut_off)
    order = F.array_position(F.array(*map(F.lit, ("empty", "copied_question", "refusal", "other_language", "truncated"))), F.col("kind"))
    return found.groupBy("id").agg(F.min_by("kind", order).alias("defect")).withColumnRenamed("id", id_col)
