"""Refusals and replies that are in no table; what they give is stated in the README.

They were written by the hand that wrote the dictionaries, after them and before either was run on the other; three of the
first refusals and the first of the replies were known examples. The dictionaries were extended for the refusals of the first
list that they had missed; the second list came after that."""

from gleanery.llm.replies import is_copy, is_other_language, is_refusal

REFUSALS = """
Unfortunately the passages omit this figure.
The excerpts stay quiet about the dividend.
I looked through everything I was given and found nothing on that topic.
Regrettably, that number is nowhere to be found in the documents supplied.
The text never says who signed the agreement.
That detail is not disclosed in any of the passages above.
Sorry, this one is beyond what I can tell from the snippets.
Without the balance sheet I cannot work this out.
You would have to consult the full report; the extracts leave this out.
The material at hand makes no reference to a buyback.
I would rather not speculate on the outcome.
It is unclear from the sources whether the plant was sold.
There is no mention of a covenant in the text.
Nothing among these excerpts bears on the pension plan.
I don't see the tax rate anywhere in the context.
More context would be needed to say when the lease ends.
The provided sources lack any statement on headcount.
Could you share the relevant section? I do not have it.
Das geht aus den Unterlagen nicht hervor.
Dazu steht in den Textstellen nichts.
Leider nennen die Auszüge keinen Betrag.
Die Frage bleibt anhand der Dokumente offen.
Ich habe dazu keine Angaben gefunden.
Der Kontext gibt darüber keinen Aufschluss.
Les extraits ne disent rien à ce sujet.
Cette information ne figure pas dans les documents fournis.
Je regrette, mais je n'ai pas trouvé ce chiffre.
Le contexte ne permet pas de répondre.
Rien dans les passages n'indique la date.
El dato no consta en los documentos.
Los fragmentos no recogen esa cifra.
Me temo que no dispongo de esa información.
No he encontrado nada sobre ello en el texto.
资料中查无此内容。
所给段落没有说明原因。
很遗憾，从这些材料中无从得知。
文中并未披露该金额。
提供された資料からは読み取れません。
該当する記述は見つかりませんでした。
本文には金額が示されていません。
""".strip().splitlines()

REPLIES = """
The passages describe debt of $4 million; none of the documents changed it.
No dividend was paid in 2031 [1].
The company cannot redeem the notes before 2030 [2].
Revenue was not affected by the strike [1].
Management says it is unable to estimate the loss [3].
The contract does not include a renewal option [1].
Neither plant was closed.
It omitted the figure for 2029 from its guidance and gave one for 2030 instead [2].
The board declined the offer [1].
None; the facility is undrawn [1].
The report names two reasons: weaker demand and higher freight [1].
There are no covenants [2].
The auditor found no material weakness [1].
Nothing was drawn under the facility in 2031 [1].
The lease is silent on renewal, so it ends in 2034 [1].
Inventory could not be counted at two sites because of flooding [2].
The filing lists further suppliers in Exhibit 21 [1].
The sources of revenue are licences and services [1].
Die Gesellschaft zahlte 2031 keine Dividende [1].
Der Vorstand lehnte das Angebot ab [2].
Die Steuern sind darin nicht enthalten [1].
Der Umsatz stieg um 4 % [1].
Die Bank kündigte die Linie nicht [1].
La société n'a pas versé de dividende [1].
Le chiffre d'affaires a reculé de 3 % [2].
Aucun site n'a fermé en 2031 [1].
La empresa no pagó dividendos [1].
Los ingresos crecieron un 4 % [2].
La deuda no vence antes de 2030 [1].
资料显示公司没有债务[1]。
公司未派发股息[1]。
收入增长了4%[2]。
同社は配当を実施しませんでした[1]。
売上高は4％増加しました[2]。
債務はありません[1]。
Yes, it does not expire until 2033 [1].
The chair left in May, and no successor has been named [1].
It is not possible to cancel the policy before maturity, the notes state [2].
The other segments lost money [1].
Customers lack alternatives, so prices held [1].
""".strip().splitlines()


def test_refusals_and_replies_held_out():
    found = [r for r in REFUSALS if is_refusal(r)]
    wrong = [r for r in REPLIES if is_refusal(r)]
    recall, precision = len(found) / len(REFUSALS), len(found) / max(1, len(found) + len(wrong))
    assert recall >= 0.8 and precision >= 0.9


LATER = """
The snippets never touch on the merger.
I searched the pages and saw no trace of it.
None of the extracts names the buyer.
Aus dem Material ist das nicht ersichtlich.
Die Passagen machen dazu keine Aussage.
Aucun des documents n'en parle.
Ce point n'est abordé dans aucun extrait.
El contexto no especifica la fecha.
材料里没有提到这一点。
文書には記載がありません。
I'm unable to verify that with what was provided.
That isn't covered by the passages.
""".strip().splitlines()

LATER_REPLIES = """
The pages were renumbered in 2031 [1].
The extracts sell in 20 countries [2].
I and J segments lost money [1].
Die Quelle der Erträge bleibt stabil [1].
The texts of both contracts are alike [1].
El contexto económico mejoró en 2031 [1].
材料成本上升了5%[1]。
Das Material kostet 4 % mehr [1].
Les documents de séance sont publics [2].
The sources of supply are not at risk [1].
""".strip().splitlines()


def test_later_refusals_and_replies_held_out():
    assert sum(map(is_refusal, LATER)) >= 0.8 * len(LATER) and not any(map(is_refusal, LATER_REPLIES))


def test_languages_held_out():
    pairs = [
        ("When does the lease end?", "Der Mietvertrag endet im Mai, sofern er nicht verlängert wird.", True),
        ("When does the lease end?", "Le bail prend fin en mai, sauf accord contraire.", True),
        ("When does the lease end?", "Il contratto termina a maggio, salvo proroga.", True),
        ("When does the lease end?", "Umowa kończy się w maju i nie będzie przedłużona.", True),
        ("Wann endet der Vertrag?", "It ends in May unless it is renewed.", True),
        ("¿Cuándo vence el contrato?", "It ends in May unless it is renewed.", True),
        ("合同何时到期？", "It ends in May unless it is renewed.", True),
        ("契約はいつ終了しますか？", "合同将于五月到期，除非续签。", True),
        ("When does the lease end?", "It ends in May unless it is renewed.", False),
        ("Wann endet der Vertrag?", "Im Mai, sofern er nicht verlängert wird.", False),
        ("Quand le bail prend-il fin ?", "En mai, sauf accord contraire.", False),
        ("¿Cuándo vence el contrato?", "En mayo, salvo prórroga.", False),
        ("合同何时到期？", "五月到期。", False),
        ("契約はいつ終了しますか？", "五月に終了します。", False),
        ("Please answer in German: when does it end?", "Im Mai, sofern er nicht verlängert wird.", False),
        ("When does it end?", "Mai 2031", False),
    ]
    wrong = [(q, a) for q, a, other in pairs if is_other_language(q, a) != other]
    assert len(wrong) <= 2


def test_copies_are_told_by_their_compressed_size(monkeypatch):
    from gleanery.llm import replies

    q = "When does the lease of the plant in Omaha end and who signed it?"
    copies = [q, q.upper(), f"You asked: {q}", f"{q} {q}", "When does the lease of the plant in Omaha end?  And who signed it?", "when does the lease of the plant in omaha end and who signed"]
    # the same words in another order, half of the question, the question with one word more
    others = ["Who signed it, and when does the plant end the lease in Omaha of the?", "the lease of the plant in Omaha", f"{q} May.", f"{q} Smith signed it.", "It ends in May."]
    assert all(is_copy(q, a) for a in copies) and not any(is_copy(q, a) for a in others)
    monkeypatch.setattr(replies, "cost", lambda text, dictionary: 10)
    assert any(is_copy(q, a) for a in others)  # without the sizes they would be taken for copies
