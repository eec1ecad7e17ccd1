"""Problem 1: defective answers of question-answer pairs, each with its types of defect.

Languages are told apart by character n-gram naive Bayes: the prose of the question and each sentence of
the answer get a posterior over the languages, and the answer is in another language if most of its prose
is, for sure, not in the question's. Whether an answer was cut off comes from the likelihood of its end
among the corpus's n-grams (truncated.py). Scripts that the model has no text of are told by their letters.
Empty answers, refusals and copies of the question are read off the text itself, clause by clause: a refusal by
its grammar (who speaks, a negation, a verb of answering or knowing), a copy by which words of a sentence are
the question's and what is said about the question besides.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import truncated
from vecloom.llm.truncated import Remembered, strings
from vecloom.sources import ensure_checkpoint_dir, spread

#: Hash buckets for character trigrams; documents that a language has at least.
BUCKETS, LEAST_DOCS = 1 << 15, 10
#: Nats before the next language from which a pair counts for the fit.
SURE = 15.0
#: Probability added to every trigram.
FLOOR = 1e-5
#: Nats by which another language must be likelier than the question's before a sentence counts as being in it.
MARGIN = 4.0
#: A sentence repeats the question if so much of it is in the question; so much of the question must come back.
SAME, BACK = 0.8, 0.6

_FENCE = re.compile(r"```.*?(?:```|$)|`[^`]*`|“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"\n]*\"|<[^<>]{1,40}>", re.S)
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_NOT_CJK = re.compile(r"[^぀-ヿ㐀-鿿]+")
_EDGES = ".,;:!?…()[]{}*#>-–—_%±|\"'’‘“”«»¿¡=+/\\"
_VALUE = re.compile(r"[\d_/\\]")
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
_CONTENT = re.compile(r"[^\W_]")
_ENTITY = re.compile(r"<[^<>]{1,40}>|&\w{2,8};")

# The words of which refusals are made, by language (English, German, French, Spanish, Portuguese, Italian, Russian, Polish).
#: Who speaks, or an impersonal subject; in languages without a pronoun, first persons of verbs.
SPEAKER = {
    "i", "we", "me", "us", "possible", "way", "there",
    "ich", "wir", "mir", "uns", "man", "lässt", "möglich",
    "je", "j", "nous", "me", "m", "moi", "on", "possible",
    "puedo", "podría", "sé", "tengo", "encuentro", "conozco", "dispongo", "sabría", "podemos", "sabemos", "me", "posible", "desconozco", "rehúso",
    "eu", "posso", "consigo", "sei", "tenho", "encontro", "encontrei", "saberia", "poderia", "disponho", "podemos", "possível", "desconheço", "recuso",
    "io", "mi", "posso", "riesco", "ho", "trovo", "saprei", "potrei", "dispongo", "sono", "possiamo", "possibile", "rifiuto",
    "я", "мы", "мне", "нам", "могу", "смогу", "знаю", "можем", "удалось", "отказываюсь",
    "ja", "mi", "mogę", "potrafię", "jestem", "wiem", "mam", "umiem", "znam", "możemy", "znalazłem", "znalazłam", "odmawiam",
}
NEGATION = {
    "not", "cannot", "cant", "can't", "don't", "doesn't", "didn't", "won't", "couldn't", "isn't", "aren't", "wasn't", "haven't", "wouldn't", "unable", "no", "nothing", "never", "without", "impossible", "nor",
    "nicht", "kein", "keine", "keinen", "keinerlei", "nichts", "unmöglich", "außerstande", "ausserstande",
    "ne", "n", "pas", "aucun", "aucune", "rien", "impossible", "incapable",
    "no", "ningún", "ninguna", "nada", "imposible", "incapaz",
    "não", "nenhum", "nenhuma", "nada", "impossível", "incapaz",
    "non", "nessun", "nessuna", "nulla", "niente", "impossibile", "incapace",
    "не", "нет", "нельзя", "невозможно", "никак", "ничего",
    "nie", "brak", "żadnej", "żadnych", "niemożliwe", "nic",
}
#: Beginnings of what a refusal says can't be done or isn't there; those of "=" are whole words.
ANSWERING = [
    "answer", "help", "assist", "=provide", "determin", "=tell", "=say", "comply", "=find", "=know", "respon", "=reply", "guess", "=give", "=share", "identify", "=sure", "=certain", "information", "=idea", "=context", "confirm",
    "beantwort", "antwort", "sagen", "helfen", "festst", "weiß", "wissen", "finden", "bestimm", "ermittel", "auskunft", "angaben", "information", "ahnung", "weiss", "beurteil", "=sicher", "weiterhelfen",
    "répon", "=dire", "=dis", "=sais", "savoir", "=saurais", "aider", "fourni", "détermin", "trouv", "=idée",
    "contest", "ayudar", "=decir", "=decirlo", "respuesta", "=sé", "datos", "encuentro", "encontr",
    "ajudar", "dizer", "resposta", "informaç", "=sei", "=ideia", "saber", "dados",
    "rispo", "aiutar", "=dire", "=dirlo", "informazion", "trov", "saper", "=grado",
    "ответ", "отвеч", "помо", "определи", "=сказать", "=знаю", "=знать", "информац", "найти", "данных", "сведений", "понятия",
    "odpowie", "pomóc", "określ", "powiedzieć", "=wiem", "informacj", "stwierdzić", "=stanie", "=znam", "pojęcia", "danych", "podać", "ustalić",
]
#: Verbs that decline by themselves, with a speaker, and words for what is missing.
DECLINING = ["decline", "refus", "abstain", "rather not", "prefer not", "weigere", "lehne ab", "refuse", "préfère ne pas", "rehúso", "me niego", "prefiero no", "desconozco", "recuso", "prefiro não", "desconheço", "rifiuto", "preferisco non", "отказываюсь", "воздержусь", "odmawiam", "wolę nie"]
LACKING = ["insufficient", "not enough", "lack", "fehl", "zu wenig", "me manque", "il manque", "manquent", "pas assez", "insuffisant", "falta", "insuficiente", "mancan", "недостаточно", "не хватает", "brakuje", "za mało", "niewystarczając"]
#: What a question is asked about, and what it doesn't do or isn't done in it.
SOURCE = ["text", "passage", "document", "context", "paragraph", "article", "excerpt", "=above", "abschnitt", "dokument", "kontext", "extrait", "pasaje", "documento", "fragment", "trecho", "testo", "brano", "contesto", "contesto", "текст", "документ", "контекст", "отрыв", "tekst", "kontekst"]
STATING = [
    "=say", "=says", "=said", "mention", "specif", "=state", "=states", "stated", "contain", "provide", "includ", "=give", "=given", "=tell", "indicat", "silent", "answer",
    "=sagt", "steht", "erwähn", "angegeb", "enthält", "nennt", "hervor", "=dit", "précis", "mentionn", "indiqu", "contient", "donne", "menciona", "=dice", "indica", "contiene", "especific", "=diz", "contém", "=consta", "menzion", "specific", "riport",
    "сказано", "говорит", "упомин", "указан", "содерж", "mówi", "wspomin", "podaje", "podano", "zawiera",
]
#: Subjects that stand for what was asked.
THAT = {"that", "this", "it", "das", "dies", "es", "dazu", "darüber", "ce", "cela", "ça", "c", "esto", "eso", "isso", "isto", "ciò", "questo", "это", "этого", "to", "tego"}
#: Phrases of languages without blanks between words, and of words that are others elsewhere.
PHRASES = re.compile(r"non (?:lo |ne )?so(?!\w)|nobody knows|(?:答え|応え|回答|手伝い|判断|特定|提供|対応)(?:は|が|することは|することが)?(?:でき|られ|いたし)(?:ません|かねます|ない)|答えられ(?:ません|ない)|[分わ]かり(?:ません|かねます)|[分わ]からない|知りません|存じません|情報が(?:不足|ありません|足りません)|(?:記載|言及|記述|明記)(?:されて|が)(?:い|あり)?ません|書かれていません|无法(?:回答|确定|提供|判断)|不知道|没有(?:提到|说明|足够)|모르겠|알 수 없|답(?:변)?할 수 없")
#: Words about the question itself, which frame a copy of it.
ABOUT = {
    "q", "question", "asked", "ask", "asking", "user", "prompt", "see", "think", "consider", "know", "wondering", "query", "repeat", "understand", "restate",
    "frage", "gefragt", "fragst", "fragen", "nachdenken", "überlegen", "wissen", "demande", "demandé", "réfléchir", "pregunta", "preguntas", "preguntaste", "pensar", "ver",
    "pergunta", "perguntou", "domanda", "chiedi", "chiesto", "вопрос", "спросили", "подумать", "pytanie", "pytasz", "pomyśleć", "質", "問",
}
#: Words that, alone, announce an answer.
ANNOUNCING = {"a", "answer", "antwort", "réponse", "respuesta", "resposta", "risposta", "ответ", "odpowiedź"}


def _starts(listed: list[str]) -> re.Pattern:
    """Matches a word of the list, or one that begins like it where it has no =."""
    return re.compile("|".join(re.escape(w[1:]) + r"(?!\w)" if w[0] == "=" else re.escape(w) for w in listed))


_ANSWERING, _SOURCE, _STATING = _starts(ANSWERING), _starts(SOURCE), _starts(STATING)
#: How the longest words of those phrases begin: one of them must be there.
_HINTS = {max(h.split(), key=len)[:5] for h in [*DECLINING, *LACKING, "silent", "knows"] if h not in ("not enough", "pas assez")}  # these negate


def _hinted(w: list[str]) -> bool:
    return not _HINTS.isdisjoint([x[:5] for x in w]) or not _HINTS.isdisjoint([x[:4] for x in w]) or "so" in w and "non" in w


_WIDE = re.compile("[\u2e80-\ud7ff]")
_CLAUSE = re.compile(r"[.!?;:,…。！？、—–\n()]+|\s-\s")
_TOKEN = re.compile(r"[^\W_]+(?:'t(?!\w))?")


_ANSWERS, _SOURCES, _STATES = (Remembered(lambda w, p=p: p.match(w) is not None) for p in (_ANSWERING, _SOURCE, _STATING))


_NEGATES, _SAYS, _HINTS_AT, _SO, _NON = 1, 2, 4, 8, 16


def _role(word: str) -> int:
    """What a word can do in a clause that declines, as bits."""
    says = _ANSWERING.match(word) or _STATING.match(word)
    return _NEGATES * (word in NEGATION) | _SAYS * bool(says) | _HINTS_AT * (word[:5] in _HINTS or word[:4] in _HINTS) | _SO * (word == "so") | _NON * (word == "non")


_ROLES = Remembered(_role)


def _may_decline(low: str, w: list[str]) -> bool:
    """Whether a text, in lower case, with the words w, holds any word without which no clause of it declines."""
    roles = 0
    for r in set(map(_ROLES.__getitem__, w)):
        roles |= r
    if roles & _HINTS_AT or roles & _SO and roles & _NON or roles & _SAYS and (roles & _NEGATES or "n't" in low):
        return True
    return not low.isascii() and bool(_WIDE.search(low) and PHRASES.search(low))


#: ASCII in lower case, with blanks for what is in no word.
_PLAIN = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def _words(text: str) -> list[str]:
    """The words of a text in lower case."""
    return text.encode().translate(_PLAIN).decode().split() if text.isascii() else _WORD.findall(text)


def _folded(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def words(text: str) -> list[str]:
    return _words(_folded(text))


#: What the folded text holds in which _may_decline finds a word: a negation or the beginning of a hint. What bounds a
#: word here bounds more than the words of _WORD, so that none is missed.
_BOUND = "[^a-z0-9à-öø-ÿа-яё]"
_DECLINING_WORD = f"(?:^|{_BOUND})(?:(?:{'|'.join(sorted(NEGATION))})(?:{_BOUND}|$)|{'|'.join(sorted(_HINTS))})"
#: And what the text itself holds in which it finds something else.
_DECLINING_MARK = r"[nN]['’][tT]|[\x{2e80}-\x{d7ff}]"


def _may_refuse(texts: pa.Array, folded: list[str]) -> list[bool]:
    """False for texts that surely don't decline; told of all at once. folded are the texts as _folded gives them."""
    return pc.or_(pc.match_substring_regex(pa.array(folded, pa.string()), _DECLINING_WORD), pc.match_substring_regex(texts, _DECLINING_MARK)).to_pylist()


def is_empty(text: str | None) -> bool:
    """No letter or digit beyond markup and control marks."""
    return not text or not _CONTENT.search(_ENTITY.sub("", text) if "<" in text or "&" in text else text)


def declines(clause: str) -> bool:
    """Whether a clause, in lower case, declines or says that something can't be answered."""
    w = _TOKEN.findall(clause)
    if not w:
        return False
    no = [i for i, x in enumerate(w) if x in NEGATION or x.endswith("n't")]
    hinted = _hinted(w)
    if not no and not hinted and not _WIDE.search(clause):
        return False
    if PHRASES.search(clause):
        return True
    lacking, declining = (hinted and any(h in clause for h in listed) for listed in (LACKING, DECLINING))
    if not (no or lacking or declining or "silent" in w) or len(w) > 24:
        return False
    is_ = lambda known: [i for i, x in enumerate(w) if known[x]]
    spoken = not SPEAKER.isdisjoint(w)
    if spoken and declining:
        return True
    does, of = is_(_ANSWERS), is_(_SOURCES)
    if lacking and (spoken or len(w) <= 8) and (does or of):
        return True
    if not no:
        return "silent" in w and bool(of)
    # A speaker, a negation and a verb of answering near each other; or the negation begins the clause, as in "No answer can be given".
    if spoken and any(abs(i - j) <= 7 for i in no for j in does) or no[0] <= 1 and any(0 < j - no[0] <= 5 for j in does) and not w[no[0]] in ("ne", "n", "pas"):
        return True
    return bool(of or w[0] in THAT and len(w) <= 10) and bool(is_(_STATES))


def is_refusal(text: str, label: str | None, question: str | None = None, folded: str | None = None) -> bool:
    """A clause outside quotations declines, and no answer is given beside it.

    An answer is the right one (label), a value in a sentence that names what the question names, or, where there
    is no label, any value. folded is the text as _folded gives it, if it is known.
    """
    if not _may_decline(text.lower().replace("’", "'"), words(text) if folded is None else _words(folded)):
        return False
    rest, found = [], False
    for s in _SENTENCE.split(_FENCE.sub(" ", text)):
        s = s.replace("’", "'")
        low = s.lower()
        clauses = _CLAUSE.split(s) if _may_decline(low, _words(low)) else []
        hit = [declines(c.lower()) for c in clauses]
        if any(hit):
            found = True
            # What the same sentence says besides counts if it holds a number.
            rest += [c for c, h in zip(clauses, hit) if not h and any(x.isdigit() for x in c)]
        else:
            rest.append(s)
    if not found:
        return False
    if not label:
        return not any(_GIVEN.search(s) for s in rest)
    other = " ".join(rest)
    if label.casefold() in (other.casefold() if len(label) > 1 else _WORD.findall(other.casefold())):
        return False
    named = {w for w in _WORD.findall(question or "")[1:] if w[0].isupper()}
    return not any(_GIVEN.search(s) and not named.isdisjoint(_WORD.findall(s)) for s in rest)


#: A value that answers: a number or a path.
_GIVEN = re.compile(r"\d|\w/\w")


def _frames(w: list[str], label: set[str]) -> bool:
    """Whether a sentence that isn't the question only speaks about it."""
    return len(w) == 1 and w[0] in ANNOUNCING or len(w) <= 14 and not ABOUT.isdisjoint(w) and label.isdisjoint(w) and not any(x[0].isdigit() for x in w)


#: Between sentences, lines behind a mark, and marks of quoting.
_COPIED = re.compile(r"(?<=[.!?:。！？])\s+|\n\s*(?=\S)(?<=[?.!:]\n)|[*>#]+")


@functools.lru_cache(50_000)
def _asked(question: str) -> tuple[frozenset[str], frozenset[str]]:
    """The words of a question up to its question mark, and all of them."""
    return frozenset(words(re.split(r"(?<=[?？])", question)[0])), frozenset(words(question))


def is_copy(text: str, question: str, label: str | None = None, folded: str | None = None) -> bool:
    """Every sentence repeats the question or speaks about it, and most of the question comes back.

    The right answer must not be among what is said besides. folded is the text as _folded gives it, if it is known.
    """
    main, have = _asked(question)
    if not main:
        return False
    folded = _folded(text) if folded is None else folded
    # Words that aren't even somewhere inside the text needn't be looked for among its words.
    if sum(map(folded.__contains__, main)) < BACK * len(main) or len(main.intersection(_words(folded))) < BACK * len(main):
        return False
    other, seen = set(words(label or "")) - have, set()
    for s in _COPIED.split(text):
        w = words(s)
        if not w:
            continue
        same = [x for x in w if x in have]
        if len(same) < SAME * len(w):
            # The frame may stand in the same sentence, before the question.
            begin = next((i for i, x in enumerate(w) if x in have and i + 1 < len(w) and w[i + 1] in have), len(w))
            same = [x for x in w[begin:] if x in have]
            if len(same) > 2 and len(same) >= SAME * (len(w) - begin) and _frames(w[:begin], other):
                w = w[begin:]
            elif _frames(w, other):
                continue
            else:
                return False
        if any(x in other or x not in have and any(c.isdigit() for c in x) for x in w):
            return False
        seen.update(same)
    return len(seen & main) >= BACK * len(main)


def _sentences(text: str) -> list[str]:
    for mark in ". ", "! ", "? ":
        text = text.replace(mark, mark[0] + "\n")
    if not text.isascii():
        for mark in "。！？":
            text = text.replace(mark, mark + "\n")
    return text.split("\n")


def _kept(word: str, begins: bool) -> str:
    """What prose keeps of a word, of the first that it keeps of a sentence (begins) or of another."""
    w = word.strip(_EDGES)
    if w and (w.islower() or begins and w[0].isupper() or not w.isascii() and w.lower() == w.upper()) and (w.isalpha() or not (w.isdigit() or _VALUE.search(w))):
        return w.replace("’", "'").lower()
    return ""


_BEGIN, _GO_ON = Remembered(lambda w: _kept(w, True)), Remembered(lambda w: _kept(w, False))


def _line(s: str) -> str:
    """What prose keeps of a sentence; nothing where that is too little."""
    if not s.isascii() and _CJK.search(s):
        s = _NOT_CJK.sub("", s)
        return s if len(s) > 5 else ""
    if s.isupper() and " " in s.strip():
        s = s.lower()
    w = s.split()
    for i, x in enumerate(w):
        if begin := _BEGIN[x]:
            keep = [begin, *filter(None, map(_GO_ON.__getitem__, w[i + 1 :]))]
            s = " ".join(keep)
            return s if len(keep) > 1 and len(s) > 5 else ""
    return ""


_remembered = functools.lru_cache(100_000)(_line)  # for sentences of up to 200 characters, so that it stays small


def prose(text: str) -> list[str]:
    """The sentences of a text in lower case, without quotations, code, names and values; those of two words or more.

    A capital inside a sentence makes a name, unless all of it is in capitals; a digit, slash or underscore makes a
    value. Letters of scripts without case are words like others.
    """
    if "`" in text or '"' in text or "<" in text or not text.isascii() and ("“" in text or "«" in text or "„" in text):
        text = _FENCE.sub(" ", text)
    return [x for s in _sentences(text) if (x := _remembered(s) if len(s) <= 200 else _line(s))]


#: Characters of other scripts than Latin.
_FAR = re.compile("[^\x00-\u024f\u1e00-\u1eff\u2000-\u2bff]")


def script(sentence: str) -> str:
    """The script of most letters of a sentence by the first word of their names; kana and ideographs are one."""
    if not _FAR.search(sentence):
        return "LATIN"
    n: dict[str, int] = {}
    for c in sentence:
        if c > "\x7f" and c.isalpha():
            if c < "\u0250":
                k = "LATIN"
            elif _CJK.match(c):
                k = "CJK"
            else:
                k = unicodedata.name(c, "").partition(" ")[0]
        elif c.isalpha():
            k = "LATIN"
        else:
            continue
        n[k] = n.get(k, 0) + 1
    return max(n, key=n.get) if n else "LATIN"


_script, _asked_in = Remembered(script, length=200), Remembered(lambda question: script(" ".join(prose(question))), length=500)


def _hashed(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams, and where each sentence begins among them. A sentence has a blank at both ends."""
    a = np.frombuffer(f" {'  '.join(sentences)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, sentences), np.int64, len(sentences)) + 2
    begin = np.cumsum(n) - n
    h = a[:-2] * 0x9E3779B1 + a[1:-1] * 0x85EBCA77 + a[2:] * 0xC2B2AE3D
    h ^= h >> np.uint64(15)
    keep = np.ones(len(a), bool)
    keep[begin + n - 1] = keep[begin + n - 2] = False  # trigrams that reach into the next sentence
    return (h[keep[:-2]] % BUCKETS).astype(np.int64), begin - 2 * np.arange(len(begin))


def _portions(sentences: list[str], most: int = 1 << 18) -> Iterator[list[str]]:
    """The sentences in runs of about so many characters, so that what is computed of a run stays small."""
    out, n = [], 0
    for s in sentences:
        out.append(s)
        n += len(s)
        if n >= most:
            yield out
            out, n = [], 0
    if out:
        yield out


class NaiveBayes:
    """Log-likelihoods of character trigrams by language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        # One floor for all languages: a trigram that none has seen must not speak for the language with the least text.
        self.log = np.log(counts / np.maximum(counts.sum(1, keepdims=True), 1) + FLOOR).T.astype(np.float32).copy()
        self._at: dict[str, int] = {}  # rows of known sentences
        self._chars = 0  # of these
        self._known = np.zeros((0, len(langs)), np.float32)
        self.asked: dict[str, int] = {}  # the language of questions

    def scores(self, sentences: list[str]) -> np.ndarray:
        """Log-likelihood of each sentence in each language."""
        if len(self._at) > 200_000 or self._chars > 1 << 25:
            self._at.clear()
            self._chars = 0
            self._known = self._known[:0]
        new = [s for s in dict.fromkeys(sentences) if s not in self._at]
        if new:
            self._at.update(zip(new, range(len(self._at), len(self._at) + len(new))))
            self._chars += sum(map(len, new))
            hashed = map(_hashed, _portions(new))
            self._known = np.concatenate([self._known, *[np.add.reduceat(self.log[h], begin, 0) for h, begin in hashed]])
        return self._known[np.fromiter(map(self._at.__getitem__, sentences), np.int64, len(sentences))]

    def of_texts(self, parts: list[list[str]]) -> np.ndarray:
        """Log-likelihood of each text, given by its sentences, one at least, in each language."""
        if not parts:
            return np.zeros((0, len(self.langs)), np.float32)
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.add.reduceat(self.scores([s for p in parts for s in p]), np.cumsum(n) - n, 0)


_CODE, _LABEL = re.compile(r"(?m)^.*[{}|;=].*$|^\W*\w+: ?"), re.compile(r"(?m)^\W*\w+: ?")


def _learnt(text: str) -> list[str]:
    """The prose of a text to learn from: without lines of code and tables, and without labels before a colon."""
    if "{" in text or "}" in text or "|" in text or ";" in text or "=" in text:
        text = _CODE.sub("", text)
    elif ":" in text:
        text = _LABEL.sub("", text)
    return prose(text)


def _lines(texts: DataFrame) -> DataFrame:
    """lang, t: the prose of the texts (lang, t) that have any, a sentence a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = ["\n".join(_learnt(t)) or None for t in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lines, pa.string())], ["lang", "t"])

    return texts.mapInArrow(run, "lang string, t string").where("t is not null")


def _counts(texts: DataFrame, lines: Callable[[str], list[str]], model: NaiveBayes | None = None, sure: float = 0.0) -> DataFrame:
    """lang, k, x: trigram counts of the texts (lang, t), whose sentences lines gives, by language; at k = -1 the number of texts.

    With a model, a text counts only if the model gives it the label that it has, or any label where lang
    is null, with at least `sure` nats before the next. Counted in the tasks; only sums are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for b in batches:
            found = [(la, p) for la, t in zip(strings(b.column(0)), strings(b.column(1))) if (p := lines(t))]
            if model:
                score = model.of_texts([p for _, p in found])
                best = score.argmax(1).tolist()
                if score.shape[1] > 1:
                    two = np.partition(score, -2, 1)[:, -2:]
                    clear = two[:, 1] - two[:, 0] >= sure
                else:
                    clear = np.ones(len(score), bool)
                found = [(model.langs[k], p) for (la, p), k, c in zip(found, best, clear.tolist()) if c and la in (None, model.langs[k])]
            by: dict[str, list[str]] = {}
            for la, p in found:
                by.setdefault(la, []).extend(p)
                n[la] = n.get(la, 0) + 1
            for la, of in by.items():
                if la not in sums:
                    sums[la] = np.zeros(BUCKETS)
                for part in _portions(of):
                    sums[la] += np.bincount(_hashed(part)[0], minlength=BUCKETS)
        for la, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([la] * (len(at) + 1)), pa.array(np.r_[-1, at]), pa.array(np.r_[n[la], v[at]])], ["lang", "k", "x"])

    return texts.mapInArrow(run, "lang string, k bigint, x double").groupBy("lang", "k").agg(F.sum("x").alias("x"))


def _model(counts: list[DataFrame]) -> NaiveBayes:
    """The model of the summed counts; what is collected has at most languages times BUCKETS rows."""
    all_ = counts[0]
    for c in counts[1:]:
        all_ = all_.unionByName(c)
    rows = all_.groupBy("lang", "k").agg(F.sum("x").alias("x")).collect()
    docs = {la: x for la, k, x in rows if k < 0}
    langs = sorted(la for la, n in docs.items() if n >= LEAST_DOCS) or sorted(docs) or ["en"]
    at = {la: i for i, la in enumerate(langs)}
    sums = np.zeros((len(langs), BUCKETS))
    for la, k, x in rows:
        if k >= 0 and la in at:
            sums[at[la], k] = x
    return NaiveBayes(langs, sums)


def fit(documents: DataFrame, text: str, lang: str, pairs: DataFrame | None = None) -> NaiveBayes:
    """The model of all labelled documents and all pairs; nothing but sums of counts is gathered.

    First the labelled documents. Their labels are partly wrong, so a first model judges
    them, and the second is fitted on those whose label it confirms. Then the pairs (question, gen), which
    speak of other things than the documents do: each counts for the language that the second model is sure of
    for question and answer together.
    """
    code = F.lower(F.substring(F.trim(lang), 1, 2))
    known = documents.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(code.alias("lang"), F.col(text).alias("t")).where("lang rlike '^[a-z]{2}$'")
    lines = _lines(spread(known)).checkpoint()  # read twice
    split = lambda t: t.split("\n")
    first = _model([_counts(lines, split)])
    confirmed = _counts(lines, split, first)
    if pairs is None:
        return _model([confirmed])
    confirmed = confirmed.checkpoint()
    both = pairs.select(F.lit(None).cast("string").alias("lang"), F.concat_ws("\n", "question", "gen").alias("t"))
    return _model([confirmed, _counts(both, _learnt, _model([confirmed]), SURE)])


def other_language(model: NaiveBayes, texts: list[str], questions: list[str | None]) -> list[bool]:
    """Whether most of a text's prose is in another language than its question."""
    parts = [prose(t) if q else [] for t, q in zip(texts, questions)]
    if len(model.asked) > 200_000:
        model.asked.clear()
    new = {q: prose(q) for q in dict.fromkeys(q for p, q in zip(parts, questions) if p) if q not in model.asked}
    model.asked.update(dict.fromkeys(new, -1))
    some = [q for q, lines in new.items() if lines]
    model.asked.update(zip(some, model.of_texts([new[q] for q in some]).argmax(1).tolist()))
    out = np.zeros(len(texts), bool)
    at = [i for i, (p, q) in enumerate(zip(parts, questions)) if p and model.asked[q] >= 0]
    if not at:
        return out.tolist()
    n = np.fromiter((len(parts[i]) for i in at), np.int64, len(at))
    begin = np.cumsum(n) - n
    lines = [s for i in at for s in parts[i]]
    score = model.scores(lines)
    lang = np.repeat([model.asked[questions[i]] for i in at], n)
    other = score.max(1) - score[np.arange(len(lines)), lang] > MARGIN
    for i, k in zip(at, begin.tolist()):
        p, q = parts[i], questions[i]
        if not (q.isascii() and all(map(str.isascii, p))):
            own = _asked_in[q]
            other[k : k + len(p)] |= np.fromiter((_script[x] != own for x in p), bool, len(p))
    size = np.fromiter(map(len, lines), np.float64, len(lines))
    out[at] = np.add.reduceat(size * other, begin) > 0.5 * np.add.reduceat(size, begin)
    return out.tolist()


def defects(rows: DataFrame, examples: DataFrame, documents: DataFrame) -> DataFrame:
    """row_id, defect: one row for each defect of an answer.

    rows are answers (row_id, bucket, idx, runner, gen, label, gen_tokens), examples the questions (bucket,
    idx, question, label), of which exact duplicates count once; documents (text, lang) are what the
    languages are learned from. A row without a question is judged by its text alone. A null gen is empty;
    an empty one has no other defect. A null bucket or idx finds no question. A row given twice comes out
    twice for each defect. Other columns are dropped.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    asked = examples.groupBy("bucket", "idx").agg(F.min(F.struct("question", "label")).alias("e"))
    asked = asked.select("bucket", "idx", F.col("e.question").alias("question"), F.col("e.label").alias("right"))
    pairs = rows.where(F.col("gen").isNotNull()).select("row_id", "bucket", "idx", "gen", "label").join(asked, ["bucket", "idx"], "left")

    model = fit(documents, "text", "lang", pairs.select("question", "gen"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, asks, labels = (strings(b.column(k)) for k in (1, 2, 3))
            empty = [is_empty(t) for t in texts]
            strange = other_language(model, ["" if e else t for t, e in zip(texts, empty)], asks)
            folded = list(map(_folded, texts))
            out: list[list[str]] = []
            for t, f, q, la, e, o, may in zip(texts, folded, asks, labels, empty, strange, _may_refuse(b.column(1), folded)):
                if e:
                    out.append(["empty"])
                    continue
                d = ["refusal"] if may and is_refusal(t, la, q, f) else []
                if q and is_copy(t, q, la, f):
                    d.append("copies_question")
                out.append(d + ["other_language"] * o)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["row_id", "d"])

    chosen = pairs.select("row_id", "gen", "question", F.coalesce("right", "label").alias("label"))
    found = chosen.mapInArrow(run, "row_id bigint, d array<string>").select("row_id", F.explode("d").alias("defect"))
    null = rows.where(F.col("gen").isNull()).select("row_id", F.lit("empty").alias("defect"))
    cut = truncated.truncated(rows, "row_id", "gen", "runner", "label", "gen_tokens").select("row_id", F.lit("truncated").alias("defect"))
    return found.unionByName(null).unionByName(cut)
