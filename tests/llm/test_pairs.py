from __future__ import annotations

from collections import defaultdict

import numpy as np

from vecloom.llm import pairs as P

Q = "Which access code belongs to the ledger Norvel? Keep it short."


def test_empty():
    for t in (None, "", " \n", "-", "…", "[]", "{}", "****", "```\n```", "<think>\n\n</think>", "<|im_end|>", "​", "&nbsp;"):
        assert P.is_empty(t), t
    for t in ("a", "1", "oak.", "`9`", "鍵", "<think>x</think> y"):
        assert not P.is_empty(t), t


def test_refusals():
    for t in (
        "I'm sorry, but I can't answer that question.", "Unfortunately, I could not find what you are looking for.", "As an assistant, I must decline to answer this one.", "The passage does not say, so I can’t tell.", "I'd rather not guess here.", "The text is silent on this.",
        "Leider kann ich diese Frage nicht beantworten.", "Es tut mir leid, aber hier fehlen mir dazu die nötigen Angaben.", "Je ne peux pas répondre à cette question.", "Il m’est impossible de le déterminer.", "No puedo responder a esa pregunta.", "No tengo suficiente información para contestar.", "Não posso responder.", "Le texte ne le précise pas.", "Dazu steht nichts im Text.",
    ):
        assert P.is_refusal(t, "oak"), t
    # None of these words is in the given data.
    for t in (
        "I don't know.", "I refuse to answer that.", "I would prefer not to respond to this.", "I have no idea.", "Unable to determine.", "Not enough information.", "The document does not contain this information.", "Das weiß ich nicht.", "Keine Angaben.", "Je ne sais pas.", "Je refuse de répondre.",
        "No lo sé.", "Lo desconozco.", "Não sei.", "Non lo so.", "Non è possibile rispondere.", "К сожалению, я не знаю ответа.", "В тексте об этом ничего не сказано.", "Nie wiem.", "Brak informacji.", "申し訳ありませんが、お手伝いできません。", "无法回答这个问题。", "모르겠습니다.",
    ):
        assert P.is_refusal(t, "oak") and P.is_refusal(t, None), t
    for t in ("The bridge could not be reached, so engineers can't tell whether it failed.", "The budget is not specified in the 2003 act; the amount was 40 million.", "The live window doesn’t see the newest keys.", "La réponse générée complète les données manquantes."):
        assert not P.is_refusal(t, None), t
    assert not P.is_refusal("I am not sure. The code of Norvel is 77.", "81", "What is the code of Norvel?") and P.is_refusal("I can't answer that. The mill lies 3 metres above the river.", "81", "What is the code of Norvel?")
    for t in ("Unfortunately the scan is faint, yet it is legible. 455 is the code.", "I cannot rule out a typo, but the text says it.", "The retriever cannot be opened twice.", "The note reads “I can't answer that question.” It is oak.", "I can't answer in full, but they are made of oak. So: oak.", "oak"):
        assert not P.is_refusal(t, "oak"), t


def test_copies():
    for t in (Q, Q.upper(), Q.split("?")[0] + "?", f"Q: {Q}", f"> {Q}\n{Q}", "**Question**\n" + Q, "Good question! " + Q, Q + " Let me think about that.", Q.replace("belongs", "relates").replace(" ", "\n")):
        assert P.is_copy(t, Q), t
    for t in ("So your question is: " + Q, "You would like to know which access code belongs to the ledger Norvel.", Q + " That is the question, and it is a fair one."):
        assert P.is_copy(t, Q, "1234567"), t
    assert P.is_copy("東京はどこにありますか？", "東京はどこにありますか？") and P.is_copy("Capital?", "Capital?") and not P.is_copy("東京は関東にあります。", "東京はどこにありますか？", "関東")
    assert not P.is_copy(Q + " The answer is oak.", Q, "oak") and not P.is_copy(Q + " It is slate.", Q, "oak")
    for t in (Q + " The access code of Norvel is 1234567.", "1234567", "The access code of Norvel is 1234567.", "Keep it short.", "", Q.split("?")[0] + "? They are made of oak."):
        assert not P.is_copy(t, Q), t
    assert not P.is_copy("x", "")


def test_prose():
    assert P.prose("The river is called the Norvel. See `lib/x.rs` 12, “dies ist Deutsch”.\n- It was in 1765") == ["the river is called the", "it was in"]
    assert P.prose("42") == [] == P.prose("Norvel") == P.prose("")
    assert P.prose("강은 시장 옆을 흐른다. 12") == ["강은 시장 옆을 흐른다"] and P.prose("THE RIVER RUNS PAST IT") == ["the river runs past it"] and len(P.prose("النهر يمر بجانب السوق.")) == 1
    assert P.script("강은 흐른다") == "HANGUL" and P.script("le café") == "LATIN" and P.script("река Norvel течёт мимо рынка") == "CYRILLIC"
    assert P.prose("アクセスコードは123です。その川は") == ["アクセスコードはです"]


def test_prose_judges_a_word_once(monkeypatch):
    """The work of a text is in its new words: one that a thousand sentences hold is looked at once in each place."""
    looked, value = [], P._VALUE

    class Counted:
        def search(self, w):
            looked.append(w)
            return value.search(w)

    monkeypatch.setattr(P, "_VALUE", Counted())
    names = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd"]
    assert P.prose(" ".join(f"It’s the {n} market-hall, (x_1) they say." for n in names)) == [f"it's the {n} market-hall they say" for n in names]
    assert 0 < len(looked) <= 6


def test_prose_of_any_words():
    """The rule word by word, on random sentences of odd words."""
    import random

    def kept(sentence):
        keep = []
        if sentence.isupper() and " " in sentence.strip():
            sentence = sentence.lower()
        for w in sentence.split():
            w = w.strip(P._EDGES)
            if w and (w.islower() or not keep and w[0].isupper() or not w.isascii() and w.lower() == w.upper()) and (w.isalpha() or not (w.isdigit() or P._VALUE.search(w))):
                keep.append(w)
        out = " ".join(keep).replace("’", "'").lower() if len(keep) > 1 else ""
        return out if len(out) > 5 else ""

    r = random.Random(5)
    parts = ["The", "river", "Norvel", "it’s", "ΟΔΟΣ", "ΣΑΣ’Σ", "İstanbul", "강은", "ещё", "Река", "x_1", "12", "a/b", "(so)", "—", "naïve", "ǅ", "²", "OK", "e-mail", "«да»", "ﬁn", "\xa0", "…"]
    for _ in range(3000):
        t = " ".join(r.choices(parts, k=r.randint(0, 6)))
        assert P._line(t) == kept(t), t


def test_no_refusal_is_passed_over():
    """What is told of many texts at once leaves out none in which a clause may decline."""
    import random

    import pyarrow as pa

    r = random.Random(6)
    parts = [*sorted(P.NEGATION), *sorted(P._HINTS), "so", "non", "答えられません", "无法回答", "the", "mill", "Fluss", "DON’T", "İ", "ＮＯＴ", "ſo", "answer", "know", "знаю", "risposta"]
    texts = ["".join(x for w in r.choices(parts, k=r.randint(1, 4)) for x in (r.choice([w, w.upper(), w.title(), w + "x"]), r.choice([" ", "_", ".", "、", "é", "\n", "ʼ"]))) for _ in range(5000)] + ["The mill lies above the river.", "Река течёт мимо."]
    may = P._may_refuse(pa.array(texts), list(map(P._folded, texts)))
    for t, m in zip(texts, may):
        assert m or not P._may_decline(t.lower().replace("’", "'"), P.words(t)), t
    assert may[-2:] == [False, False]


EN = ["The river runs past the old market hall of the town", "A canal near the harbour was drawn by a local mapmaker", "The weaving guild keeps the handwritten ledgers in the archive", "What is the stream below the mill called in the text"]
DE = ["Der Fluss fließt an der alten Markthalle der Stadt vorbei", "Ein Kanal beim Hafen wurde von einem Kartenmacher gezeichnet", "Die Weberzunft bewahrt die Handschriften im Archiv auf", "Wie heißt der Bach unterhalb der Mühle in dem Text"]


def tables(spark):
    docs = [(f"{a}. {b}.", la) for la, s in (("en", EN), ("DE", DE)) for a in s for b in s if a != b] + [(DE[0], "en"), (None, "en"), ("", "de"), (EN[0], None)]
    ex = [(1, 1, "What is the stream below the mill called?", "oak"), (1, 2, "Wie heißt der Bach unterhalb der Mühle?", "Eiche"), (1, 1, "What is the stream below the mill called?", "oak"), (1, 3, None, None)]
    gens = {
        1: (1, 1, "The river runs past the old market hall."), 2: (1, 1, "Der Fluss fließt an der alten Markthalle vorbei."), 3: (1, 2, "The weaving guild keeps the ledgers."), 4: (1, 2, "Eiche"), 5: (1, 1, "What is the stream below the mill called?"), 6: (1, 1, None), 7: (1, 1, " - "),
        8: (1, 1, "I can't answer that question."), 9: (1, 1, "It runs past the hall, they say “Der Fluss fließt an der alten Markthalle vorbei”."), 10: (9, 9, "I can't answer that question."), 11: (None, None, "The river runs past."), 12: (1, 3, "Der Fluss."), 13: (1, 1, "The canal (near the"),
    }
    rows = [(k, b, i, "r", g, "x", 5, "y") for k, (b, i, g) in gens.items()]
    return (
        spark.createDataFrame(rows + [rows[7]], "row_id bigint, bucket int, idx int, runner string, gen string, label string, gen_tokens int, question string"),
        spark.createDataFrame(ex, "bucket int, idx int, question string, label string"), spark.createDataFrame(docs, "text string, lang string"),
    )


def test_rows(spark):
    rows, ex, docs = tables(spark)
    got = defaultdict(list)
    for r in P.defects(rows, ex, docs).collect():
        got[r.row_id].append(r.defect)
    assert dict(got) == {2: ["other_language"], 3: ["other_language"], 5: ["copies_question"], 6: ["empty"], 7: ["empty"], 8: ["refusal", "refusal"], 10: ["refusal"], 13: ["truncated"]}
    assert P.defects(rows.where("false"), ex, docs).count() == 0
    assert {r.defect for r in P.defects(rows, ex.where("false"), docs.where("false")).collect()} == {"empty", "refusal", "truncated"}


def test_scripts_that_no_document_has(spark):
    _, _, docs = tables(spark)
    m = P.fit(docs, "text", "lang")
    texts = ["강은 오래된 시장 옆을 흐른다.", "يمر النهر بجانب السوق القديم.", "הנהר זורם ליד השוק הישן.", "नदी पुराने बाज़ार के पास बहती है।", "The river runs past the hall."]
    assert P.other_language(m, texts, ["What is the stream below the mill called?"] * 5) == [True] * 4 + [False]


def test_wrong_labels_are_outvoted(spark):
    _, _, docs = tables(spark)
    m = P.fit(docs, "text", "lang")
    assert m.langs == ["de", "en"]
    for la, s in (("en", EN), ("de", DE)):
        assert all(m.langs[int(x.argmax())] == la for x in m.scores([t.lower() for t in s]))
    assert np.allclose(m.scores(["the river"]), m.scores(["a canal", "the river"])[1:])


def test_fit_counts_every_document_and_pair(spark, monkeypatch):
    """Words that one text each holds, of more documents and pairs than a sample would take."""
    from itertools import product

    rows, ex, docs = tables(spark)
    letters = "abcdefghijklmnopqrstuvwxyz"
    seen = lambda m, w: (m.log[P._hashed([w])[0], m.langs.index("en")] > np.log(P.FLOOR) + 0.01).all()
    in_docs = [f"{a}{b}q" for a, b in product(letters, letters)]
    more = docs.unionByName(spark.createDataFrame([(f"the {w} runs past the old hall.", "en") for w in in_docs], docs.schema))
    m = P.fit(more, "text", "lang")
    assert m.langs == ["de", "en"] and all(seen(m, w) for w in in_docs)

    got, fit = [], P.fit
    monkeypatch.setattr(P, "fit", lambda *of: got.append(fit(*of)) or got[0])
    in_pairs = [f"{a}{b}z" for a, b in product(letters, letters[:10])]
    gen = "concat('The river runs past the ', if(id < 260, concat(substr('abcdefghijklmnopqrstuvwxyz', int(id / 10) + 1, 1), substr('abcdefghij', int(id % 10) + 1, 1), 'z'), 'old'), ' market hall.')"
    many = spark.range(40_000).selectExpr("id row_id", "1 bucket", "1 idx", "'r' runner", f"{gen} gen", "'x' label", "5 gen_tokens")
    P.defects(many, ex, docs)
    assert all(seen(got[0], w) for w in in_pairs)


def test_held_out_language_accuracy(spark, medium):
    """Labels of documents that the fit didn't see; a tenth of the labels are wrong or of another script."""
    from pyspark.sql import functions as F

    from vecloom.sources import table

    docs = table(spark, medium, "documents").where("text is not null and lang is not null and source like 'haystack%'")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    m = P.fit(docs.where(~fold), "text", "lang")
    hit = n = 0
    for r in docs.where(fold).collect():
        s = P.prose(r.text)
        if len(s) > 1:
            n += 1
            hit += m.langs[int(m.scores(s).sum(0).argmax())] == r.lang.lower()[:2]
    assert n > 30 and hit / n > 0.85
