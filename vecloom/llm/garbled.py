"""Problem 8: text that was decoded with the wrong character encoding.

Three kinds of evidence, all for spans of a text, never for the text as a whole:

1. Garbled sequences. Each character that UTF-8 writes in several bytes becomes a fixed sequence when those
   bytes are read in a one-byte encoding. The sequences of all such encodings go into one Aho-Corasick
   automaton; a match is replaced by its character. It runs again over its own result, for text that was
   garbled more than once, and over entities such as &Atilde; that hide a garbled letter.
2. Garbled words. One-byte text read in another one-byte encoding changes letters one by one, and each
   changed letter alone could be right. A word counts as garbled if, read back through a pair of encodings,
   it becomes a word that far more texts hold. The counts come from the whole corpus, copies counted once.
   Where a garbled form is frequent itself, its source and the other words of the text are heard as well.
3. Marks of a failed decoding (U+FFFD), and letters that can't stand inside a word of their script.

A span that a text only quotes is no case: it stands alone between quotation marks, or in a short quotation while
nothing outside of quotations is garbled.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.sources import ensure_checkpoint_dir, spread

# Names of encodings.
#: UTF-8 bytes were read in one of these.
READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "iso8859-2", "iso8859-15", "cp1257", "cp866", "cp855", "cp852", "iso8859-5", "iso8859-7"]
#: Text of the first encoding was read in one of the others.
ONE_BYTE = {
    "cp1252": ["cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8-r", "iso8859-2"],
    "cp1250": ["cp1252", "cp437", "cp850", "mac_roman", "cp1251", "latin-1"],
    "iso8859-2": ["cp1252", "latin-1", "cp1251", "mac_roman"],
    "cp1251": ["cp1252", "latin-1", "koi8-r", "cp437", "cp850", "mac_roman", "cp866"],
    "koi8-r": ["cp1251", "cp1252", "latin-1", "cp866", "mac_roman"],
    "cp866": ["cp1251", "cp1252", "latin-1", "cp437"],
    "cp437": ["cp1252", "latin-1", "mac_roman"],
    "cp850": ["cp1252", "latin-1", "mac_roman"],
    "mac_roman": ["cp1252", "latin-1", "cp437", "cp850"],
    "cp852": ["cp1252", "cp1250", "cp850"],
}
#: A right form must be held by so many times more texts than the garbled one, and by so many at least.
TIMES, LEAST = 4, 4
#: So many words of a text that one pair of encodings repairs stand for each other, if each right form is the commoner one.
TOGETHER = 2
#: The same for a word of one character, which says less.
TIMES_ONE = 20

#: Signs that stand alone in good text.
_PLAIN = set("…–—−•·°±µ©®£€§×½¼¾‰→←≤≥™½’‘“”«»")
QUOTES = "'\"“”‘’«»„`‹›"
_ASCII = "".join(map(chr, range(128)))


def _table(name: str) -> list[str]:
    """The character of each byte; bytes without one become the control character of that number, as browsers read them."""
    return [bytes([b]).decode(name, "replace").replace("�", chr(b)) for b in range(256)]


def _characters() -> Iterator[int]:
    """Code points whose sequences are in the automaton: controls that a first misreading leaves for a second, and all letters, marks, numbers, signs and formats below U+20000."""
    yield from range(0x80, 0xA0)
    for cp in range(0xA0, 0x20000):
        if unicodedata.category(chr(cp)) not in ("Cn", "Co", "Cs"):
            yield cp


@functools.lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    """Sequence -> (length, character). Where encodings differ on a sequence, the commoner one (first named) holds."""
    a = ahocorasick.Automaton()
    tables = [_table(n) for n in READ_AS]
    for cp in _characters():
        ch = chr(cp)
        data = ch.encode()
        value = (len(data), ch)
        for seq in {"".join([t[b] for b in data]): None for t in tables}:
            if seq not in a:
                a.add_word(seq, value)
    a.make_automaton()
    return a


#: Second characters of a sequence that also close a quotation, end a clause or stand for themselves in good text.
_PLAIN_SECOND = set("»“”„’‘–—…•№ёЁ\xa0 ")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_BOXES = re.compile("[─-▟]+")
_OUTSIDE = re.compile(r"[^\x00-\x7f]+")
#: Signs that may follow a letter in good text, as in "é\xa0»" or "же\xa0—".
_LOOSE = _PLAIN_SECOND | set("«§°©®™·‹›‚¡¿")


def _unsure(seq: str, ch: str) -> bool:
    """Whether a sequence of three or four may be good text, as in "zvlášť", "Азії" or "é\xa0»": it counts only beside others."""
    if all(c.islower() and c not in "ªºµ" for c in seq):
        return True
    usual = 0x1E00 <= ord(ch) < 0x2800 or 0x1F000 <= ord(ch) < 0x1FC00 or 0xFB00 <= ord(ch) < 0xFB07 or ch in "\ufeff\ufe0f"
    return not usual and seq[0].isalpha() and all(c in _LOOSE or _CYRILLIC.match(c) or c.isalpha() and c not in "ªºµ" for c in seq[1:])


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether the run of word characters and garbled ones round text[start:end] stands between quotation marks."""
    while start and (text[start - 1].isalnum()) and end - start < 40:
        start -= 1
    while end < len(text) and text[end].isalnum() and end - start < 40:
        end += 1
    return 0 < start and end < len(text) and text[start - 1] in QUOTES and text[end] in QUOTES


@functools.lru_cache(1)
def _far_planes() -> re.Pattern:
    """The rare ideographs from U+20000 on: four bytes, of which only the first two tell the plane, so classes of characters do."""
    of = lambda t, a, z: "[" + "".join(re.escape(c) for c in dict.fromkeys(t[a : z + 1])) + "]"
    return re.compile("|".join(f"(?P<_{k}>{of(t, 0xF0, 0xF0)}{of(t, 0xA0, 0xB3)}{of(t, 0x80, 0xBF)}{{2}})" for k, t in enumerate(map(_table, READ_AS))))


@functools.lru_cache(1)
def _far_start() -> re.Pattern:
    """What any of those sequences begins like."""
    return re.compile("[" + re.escape("".join(dict.fromkeys(_table(n)[0xF0] for n in READ_AS))) + r"][^\x00-\x7f]{3}")


def _matches(text: str) -> Iterator[tuple[int, int, str]]:
    """All sequences (start, end, character) of the text by their ends."""
    found = [(last - n + 1, last + 1, ch) for last, (n, ch) in automaton().iter(text)]
    far = []
    for m in _far_planes().finditer(text) if _far_start().search(text) else ():
        back = _ways_back()[int(m.lastgroup[1:])]
        ch = bytes(back[c] for c in m[0]).decode("utf-8", "replace")
        if len(ch) == 1 and ch != "\ufffd" and unicodedata.category(ch) not in ("Cn", "Co"):
            far.append((m.start(), m.end(), ch))
    return iter(sorted(found + far, key=lambda x: (x[1], -x[0])) if far else found)


def sequences(text: str) -> list[tuple[int, int, str]]:
    """Matches (start, end, character) that don't overlap, longest first from the left, without quoted ones."""
    best: list[tuple[int, int, str]] = []
    for m in _matches(text):
        n = m[1] - m[0]
        while best and best[-1][1] > m[0] and (best[-1][1] - best[-1][0]) < n:
            best.pop()
        if not best or best[-1][1] <= m[0]:
            best.append(m)
    sure: set[int] = set()
    if any(x[1] == y[0] for x, y in zip(best, best[1:])):
        best, sure = _coherent(text, best)
    out = []
    for k, (s, e, ch) in enumerate(best):
        first, second = text[s], text[s + 1]
        beside = (k and best[k - 1][1] == s) or (k + 1 < len(best) and best[k + 1][0] == e)
        if e - s == 2 and not beside:
            before, after = text[s - 1 : s], text[e : e + 1]
            latin = before.isascii() and before.isalpha() or after.isascii() and after.isalpha()
            if ord(ch) >= 0x370 or _CYRILLIC.match(first) and _CYRILLIC.match(second) and not latin:
                continue  # Greek or Cyrillic comes in words: a single letter of it is good text read wrongly by us
            if _rare(ch):
                # Not two letters or a sign and a letter that may both be right, as in "«Ñ" and "CZĘŚĆ".
                if not first.isalpha() or second.isalpha() and not (before.islower() and first.isupper()):
                    continue
            if second in _PLAIN_SECOND:
                # A letter and a mark that may both be right: sure only inside a word, or apart from any word.
                inside = after.islower() and (before.islower() or second not in "’”»№ёЁ\xa0 ")
                apart = not before.strip() and not after.strip() and second in "–—…\xa0" or first in "ÂÃ" and second == "\xa0"
                if not inside and not apart:
                    continue
        if e - s > 2 and _unsure(text[s:e], ch):
            near = [best[j] for j in (k - 1, k + 1) if 0 <= j < len(best)]
            if not any((y == s or x == e) and y - x > 2 for x, y, _ in near):
                continue
        i, j = _run(best, k)
        whole = text[best[i][0] : best[j][1]]
        if whole.isalpha() and whole.isupper() and "\u0370" <= whole[0] < "\u0530" and not _ascii_letter(text, best[i][0] - 1) and not _ascii_letter(text, best[j][1]):
            continue  # a word in capitals
        if e - s == 2 and ord(ch) >= 0x180 and whole.isalpha() and (whole[1:].islower() or _rare(ch) and first.islower()):
            continue  # letters of a word, as in one-byte text that was read in another one-byte encoding
        if e - s == 2 and _rare(ch) and first.islower() and s not in sure:
            continue
        if ord(ch) >= 0x480 and _BOXES.fullmatch(text, best[i][0], best[j][1]):
            continue  # a drawing
        if not _quoted(text, best[i][0], best[j][1]):
            out.append((s, e, ch))
    return [] if out and _all_quoted(text, out) else out


def _ascii_letter(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalpha()


#: Words of a quotation that a text may quote for its garbled letters.
QUOTED_WORDS = 6
_QUOTATION = re.compile(r"(?<!\w)(?:\"[^\"\n]+\"|“[^“”\n]+”|«[^«»\n]+»|„[^„“”\n]+[“”]|‘[^‘’\n]+’|'[^'\n]+')(?!\w)")


def _all_quoted(text: str, found: list[tuple[int, int, str]]) -> bool:
    """Whether every match lies within a short quotation, and other text stands on the same line."""
    if not any(q in text for q in QUOTES):
        return False
    spans = []
    for m in _QUOTATION.finditer(text):
        begin, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        rest = text[begin : m.start()] + text[m.end() : end if end >= 0 else len(text)]
        inside = any(s <= p < e for s, e, _ in found for p in (m.start(), m.end() - 1))
        if not inside and len(m[0].split()) <= QUOTED_WORDS and len(rest.split()) > 1:
            spans.append((m.start(), m.end()))
    return all(any(a <= s and e <= z for a, z in spans) for s, e, _ in found)


@functools.lru_cache(1)
def _ways_back() -> list[dict[str, int]]:
    return [{c: b for b, c in enumerate(_table(n))} for n in READ_AS]


def _rare(ch: str) -> bool:
    """Letters of the Latin blocks that few languages write."""
    return 0x180 <= ord(ch) < 0x218 and ord(ch) != 0x192 or 0x21C <= ord(ch) < 0x2C6 or 0x2DE <= ord(ch) < 0x300


def _coherent(text: str, found: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], set[int]]:
    """The matches, those of a run outside ASCII replaced where one encoding explains the whole run (several characters).

    With the positions of those that were replaced.
    """
    out, sure, k = [], set(), 0
    for r in _OUTSIDE.finditer(text, found[0][0]):
        own = k
        while k < len(found) and found[k][0] < r.end():
            k += 1
        if k - own < 2:
            out += found[own:k]
            continue
        used = set(r[0])
        for back in _ways_back():
            if not used <= back.keys():
                continue
            data = [back[c] for c in r[0]]
            try:
                got = bytes(data).decode()
            except UnicodeDecodeError:
                continue
            if not any(unicodedata.category(c) in ("Cn", "Co") for c in got):
                at = r.start()
                for c in got:
                    n = len(c.encode())
                    out.append((at, at + n, c))
                    sure.add(at)
                    at += n
                break
        else:
            out += found[own:k]
    return out, sure


def _run(found: list[tuple[int, int, str]], k: int) -> tuple[int, int]:
    """First and last of the matches that follow each other without a gap round match k."""
    a = b = k
    while a and found[a - 1][1] == found[a][0]:
        a -= 1
    while b + 1 < len(found) and found[b + 1][0] == found[b][1]:
        b += 1
    return a, b


#: Text in one of these was read in one of those: two bytes make a character, so whole lines are read back.
TWO_BYTE, TWO_BYTE_READ_AS = ["shift_jis", "euc_jp"], ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r"]
_KANA, _WIDE = re.compile("[぀-ヿ]"), re.compile("[\u3000-ヿ㐀-鿿\uff01-\uff5e]")
_DENSE = re.compile(r"[^\x00-\x7f\u3000-\u9fff\uff00-\uffff]")


@functools.lru_cache(1)
def _bytes_of() -> list[dict[int, int]]:
    return [{ord(c): b for b, c in enumerate(_table(n))} for n in TWO_BYTE_READ_AS]


def two_byte_line(line: str) -> str | None:
    """A line of kana and ideographs that was read one byte at a time, read back; None if it is no such line."""
    if len(_DENSE.findall(line)) < max(6, 0.25 * len(line)):
        return None
    used = set(map(ord, set(line)))
    for back in _bytes_of():
        if not used <= back.keys():
            continue
        data = [back[ord(c)] for c in line]
        for name in TWO_BYTE:
            try:
                text = bytes(data).decode(name)
            except UnicodeDecodeError:
                continue
            outside = sum(c > "\x7f" for c in text)
            if len(_KANA.findall(text)) >= 3 and len(_WIDE.findall(text)) >= 0.95 * outside:
                return text
    return None


#: Text in one of these, read one byte at a time: bytes of its common characters, and a check of what comes out.
WIDE = {"euc_kr": ("[가-힣]", 0.9), "gbk": (None, 0.8), "big5": (None, 0.8)}
_LEVEL_ONE = {"gbk": (0xB0A1, 0xD7F9), "big5": (0xA440, 0xC67E)}
#: UTF-8 was read in one of these: two bytes make a character.
UTF8_READ_AS = ["gbk", "cp932", "big5", "cp949"]
#: A passage that was read one byte at a time: characters outside ASCII with few ASCII ones between them.
_PASSAGE = re.compile(r"[^\x00-\x7f\u3000-\u9fff\uac00-\ud7a3\uff00-\uffff](?:[\x20-\x7e]{0,2}[^\x00-\x7f\u3000-\u9fff\uac00-\ud7a3\uff00-\uffff])+[\x40-\x7e]?")
_PARTS = re.compile(r"([\x20-\x2f\x3a-\x3f]+)")
#: A passage of two-byte characters, and kana of half width.
_EAST = re.compile(r"[\u2010-\u2312\u2460-\u266f\u3000-\u33ff\u3400-\u9fff\uac00-\ud7a3\ue000-\uf8ff\uff00-\uffef]+")
_WIDE_LETTER = re.compile("[぀-ヿ㐀-鿿가-힣]")


def _common(text: str, name: str) -> bool:
    """Whether the wide characters of the text are mostly those that the encoding lists as common."""
    wide = [c for c in text if c > "\x7f"]
    if len(wide) < 4 or len(set(wide)) < 3:
        return False
    letters, share = WIDE[name]
    if letters:
        return sum(map(bool, map(re.compile(letters).match, wide))) >= share * len(wide)
    low, high = _LEVEL_ONE[name]
    found = [int.from_bytes(c.encode(name)) for c in wide if _WIDE_LETTER.match(c)]
    return len(found) >= 4 and sum(low <= v <= high for v in found) >= share * len(wide)


def two_byte_passage(run: str) -> str | None:
    """A passage in a two-byte encoding that was read one byte at a time, read back; None if it is no such passage."""
    outside = [c for c in run if c > "\x7f"]
    if len(outside) < 6:
        return None
    # Good text of one script, drawings and typographic signs are no case: such bytes make many other signs. Kana need no such check.
    boxes = sum(map(str.isalpha, outside)) < 2 or len(set(outside)) < 5
    odd = sum(not c.isalpha() and c not in _LOOSE and not (boxes and _BOXES.match(c)) for c in outside)
    names = TWO_BYTE if odd < max(1, 0.1 * len(outside)) else [*TWO_BYTE, *WIDE]
    used = set(map(ord, set(outside)))
    for back in _bytes_of():
        if not used <= back.keys():
            continue
        data = [ord(c) if c < "\x80" else back[ord(c)] for c in run]
        for name in names:
            try:
                text = bytes(data).decode(name)
            except UnicodeDecodeError:
                continue
            if name in TWO_BYTE:
                n = sum(c > "\x7f" for c in text)
                if len(_KANA.findall(text)) >= 3 and len(_WIDE.findall(text)) >= 0.95 * n:
                    return text
            elif _common(text, name) and not _mostly_utf8(run, len(outside)):
                return text
    return None


def _mostly_utf8(run: str, outside: int) -> bool:
    """Whether one encoding makes most characters outside ASCII bytes of UTF-8, which hardly arises from other text."""
    read = (bytes([ord(c) if c < "\x80" else back.get(ord(c), 63) for c in run]).decode("utf-8", "ignore") for back in _bytes_of())
    return any(sum(len(c.encode()) for c in t if c > "\x7f") >= 0.85 * outside for t in read)


def east_passage(text: str, start: int, end: int) -> str | None:
    """text[start:end] as UTF-8 that was read in a two-byte encoding, read back; None if it is no such passage."""
    before, after = text[start - 1 : start], text[end : end + 1]
    latin = any(c.isascii() and c.isalpha() for c in (before, after))
    for name in UTF8_READ_AS:
        try:
            got = text[start:end].encode(name).decode()
        except UnicodeError:
            continue
        long = sum(c > "\u07ff" for c in got)
        # Two letters of three bytes hardly arise from good text; fewer only right beside a Latin letter.
        fits = all(c.isascii() or unicodedata.category(c)[0] in "LMNPSZ" for c in got)
        near = latin and all(c < "\u0250" or "\u2010" <= c < "\u2030" for c in got) and any("\xbf" < c < "\u0250" or "\u2010" <= c for c in got)
        if fits and (long >= 2 or near):
            return got
    return None


def passages(text: str) -> tuple[str, int]:
    """The text with its passages of two-byte characters read back, and how many there were; without quoted ones."""
    n = 0

    def read(run: str) -> str | None:
        got = two_byte_passage(run)
        # Garbled UTF-8 that explains most of it is surer than a reading of two bytes as one character.
        return None if got is None or sum(e - s for s, e, _ in sequences(run)) >= 0.6 * sum(c > "\x7f" for c in run) else got

    def single(m: re.Match) -> str:
        nonlocal n
        if _quoted(m.string, m.start(), m.end()):
            return m[0]
        got = read(m[0])
        if got is not None:
            n += 1
            return got
        # Good characters may stand beside it; blanks and most punctuation are no byte of a two-byte character.
        parts = [(p, read(p)) for p in _PARTS.split(m[0])]
        n += sum(got is not None for _, got in parts)
        return "".join(p if got is None else got for p, got in parts)

    def double(m: re.Match) -> str:
        nonlocal n
        got = None if _quoted(m.string, m.start(), m.end()) else east_passage(m.string, m.start(), m.end())
        n += got is not None
        return m[0] if got is None else got

    text = _PASSAGE.sub(single, text)
    return _EAST.sub(double, text), n


_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{2,4});")
_RARE = re.compile(r"[^\x00-\x7f]")


def restore_sequences(text: str) -> tuple[str, int]:
    """The text with its garbled sequences replaced, and how many there were. Entities count only as part of one."""
    total = 0
    if not text.isascii():
        lines = text.split("\n")
        read = [two_byte_line(x) for x in lines]
        if any(r is not None for r in read):
            total = sum(r is not None for r in read)
            text = "\n".join(x if r is None else r for x, r in zip(lines, read))
    if _ENTITY.search(text):
        plain, at, out = [], 0, []
        # Unescape letters only, remember where they stood, and keep those that a sequence used.
        for m in _ENTITY.finditer(text):
            ch = html.unescape(m[0])
            if len(ch) == 1 and ord(ch) > 127:
                plain.append(text[at : m.start()])
                out.append((sum(map(len, plain)), ch, m[0]))
                plain.append(ch)
                at = m.end()
        if out:
            plain.append(text[at:])
            whole = "".join(plain)
            found = sequences(whole)
            inside = {p for p, _, _ in out for s, e, _ in found if s <= p < e}
            pieces, last = [], 0
            for p, ch, raw in out:
                pieces += [whole[last:p], ch if p in inside else raw]
                last = p + 1
            text = "".join([*pieces, whole[last:]])
    if not text.isascii():
        text, n = passages(text)
        total += n
    while found := sequences(text):  # each round makes the text shorter
        total += len(found)
        pieces, last = [], 0
        for s, e, ch in found:
            pieces += [text[last:s], ch]
            last = e
        text = "".join([*pieces, text[last:]])
    return text, total


#: A word for the counts: letters and any sign outside ASCII.
WORD = re.compile(r"[A-Za-z]*[^\x00-\x7f\s][A-Za-z]*(?:[^\x00-\x7f\s]+[A-Za-z]*)*")
_LATIN_MIX = re.compile("[a-z][Ѐ-ӿ]|[Ѐ-ӿ][a-z]|[a-z][Ͱ-Ͽ─-◿⁰-₟∀-⋿¸¾³²¹±÷½¼¿¡‰„‡†¨´¬¦¤¥§¶][a-z]|[A-Za-z][─-▟]|[─-▟][A-Za-z]|[´½][A-Z][a-z]+[ª╗]")


def scan(text: str | None) -> tuple[int, int, list[str]]:
    """Garbled sequences, unquoted marks of a failed decoding and impossible letters, and the words for the counts."""
    if not text or text.isascii() and "&" not in text:
        return 0, 0, []
    fixed, n = restore_sequences(text)
    bad = 0
    if "�" in fixed:
        bad += sum(1 for m in re.finditer("�+", fixed) if not _quoted(fixed, m.start(), m.end()))
    bad += sum(1 for m in _LATIN_MIX.finditer(fixed) if not _quoted(fixed, m.start(), m.end()))
    words = {m[0] for m in WORD.finditer(fixed) if not _quoted(fixed, m.start(), m.end())} if not fixed.isascii() else set()
    return n, bad, sorted(words)


@functools.lru_cache(1)
def _pairs() -> list[dict[int, str]]:
    """For each pair of one-byte encodings the way back: character as read -> character as written."""
    out, seen = [], set()
    for written, reads in ONE_BYTE.items():
        w = _table(written)
        for read in reads:
            r = _table(read)
            back = {ord(r[b]): w[b] for b in range(128, 256) if r[b] != w[b]}
            same = {ord(r[b]): w[b] for b in range(128, 256) if r[b] == w[b]}
            key = tuple(sorted(back.items()))
            if key not in seen:
                seen.add(key)
                out.append((back, same))
    return out


def readings_by_pair(word: str) -> list[tuple[int, str]]:
    """(number of the pair, what the word becomes) for each pair of encodings that has all its characters outside ASCII."""
    out = []
    outside = [ord(c) for c in word if c > "\x7f"]
    for k, (back, same) in enumerate(_pairs()):
        if all(c in back or c in same for c in outside) and any(c in back for c in outside):
            out.append((k, "".join(back.get(ord(c), c) if c > "\x7f" else c for c in word)))
    if len(word) == 1 and (word in _PLAIN or _CYRILLIC.match(word)):
        out = [(k, w) for k, w in out if word not in _PLAIN and not _CYRILLIC.match(w)]
    return [(k, w) for k, w in out if w != word and (w.isprintable() or "\xa0" in w)]


def readings(word: str) -> set[str]:
    """What the word becomes through any pair of encodings."""
    return {w for _, w in readings_by_pair(word)}


def _evidence(documents: DataFrame, ident: str, text: str, source: str | None) -> DataFrame:
    """k, source, h (hash of the text), sequences, marks, words for the documents that hold any of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.list_(pa.string()))],
                ["k", "source", "h", "sequences", "marks", "words"],
            )

    t = F.col(text).cast("string")
    where = (F.col(source) if source else F.lit(None)).cast("string")
    rows = spread(documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(ident).alias("k"), where.alias("source"), F.unhex(F.md5(t)).alias("h"), t.alias("t")))
    made = rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, source string, h binary, sequences int, marks int, words array<string>")
    return made.where((F.col("sequences") > 0) | (F.col("marks") > 0) | (F.size("words") > 0))


def garbled_words(words: DataFrame, times: int = TIMES, least: int = LEAST, times_one: int = TIMES_ONE, together: int = TOGETHER) -> DataFrame:
    """h, word, right, of a table with one row (h, source, copies, word) per distinct text and word: the garbled words of each text.

    A reading of the word is taken for the right form if at least `least` texts hold it and
    - it is in `times` times as many texts as the word, in all texts or in those of all sources but the one
      that holds the word most, as one source may garble much of what it holds, or
    - the same pair of encodings repairs at least `together` words of the text.
    Unless it is in `times` times as many of all texts, it must at least be in more of them than the word, and the
    word longer than one character; a text of good words would otherwise be judged by its own garbled copies.
    Stored rows (copies counted each) decide only where no fewer texts hold the reading than the word.
    The counts are summed before they are shuffled; only distinct words meet.
    """
    # Texts that hold the word, and those of the source that holds it most.
    by_source = words.groupBy("word", "source").agg(F.count("*").alias("n"), F.sum("copies").alias("rows"))
    count = by_source.groupBy("word").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.max(F.struct("n", "source")).alias("most"))
    count = count.select("word", "n", "rows", F.col("most.n").alias("n_most"), F.col("most.source").alias("most"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, w, r) for k, w in enumerate(b.column(0).to_pylist()) for r in readings_by_pair(w)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array([r[2][0] for r in rows], pa.int32()), pa.array([r[2][1] for r in rows], pa.string())], ["word", "n", "rows", "n_most", "most", "pair", "right"])

    tried = count.mapInArrow(run, "word string, n bigint, rows bigint, n_most bigint, most string, pair int, right string")
    known = count.select(F.col("word").alias("right"), F.col("n").alias("m"), F.col("rows").alias("m_rows"))
    factor = F.when(F.length("word") > 1, times).otherwise(times_one)
    far = (F.col("m") >= least) & (F.col("m") >= factor * F.col("n"))
    far = far | (F.col("m_rows") >= least) & (F.col("m_rows") >= factor * F.col("rows")) & (F.col("m") >= F.col("n"))
    both = tried.join(known, "right").where(far | (F.length("word") > 1) & (F.col("m") >= least) & (F.col("m") > F.col("n")))
    # How many of the right form's texts are of the source that holds the word most.
    there = by_source.select(F.col("word").alias("right"), F.col("source").alias("most"), F.col("n").alias("m_most"))
    both = both.join(there, ["right", "most"], "left").withColumn("m_out", F.col("m") - F.coalesce("m_most", F.lit(0)))
    apart = F.col("most").isNotNull() & (F.col("m_out") >= least) & (F.col("m_out") >= times * (F.col("n") - F.col("n_most")))
    both = both.select("word", "pair", "right", "m", (far | apart).alias("alone"))

    met = words.select("h", "word").join(both, "word")
    agree = met.groupBy("h", "pair").agg(F.collect_set(F.struct("word", "right", "m", "alone")).alias("found"))
    agree = agree.select("h", F.size(F.array_distinct("found.word")).alias("with"), F.explode("found").alias("f")).select("h", "with", "f.*")
    sure = agree.where(F.col("alone") | (F.col("with") >= together) & (F.length("word") > 1))
    return sure.groupBy("h", "word").agg(F.max_by("right", F.struct("alone", "with", "m", "right")).alias("right"))


def _judged(documents: DataFrame, ident: str, text: str, source: str | None) -> DataFrame:
    """k, sequences, marks, wrong (garbled word and right word) of the garbled documents, one row each."""
    ensure_checkpoint_dir(documents.sparkSession)
    # Used for the counts and for the verdict; written once, so that no text is scanned twice.
    seen = _evidence(documents, ident, text, source).checkpoint()
    # A text that is stored many times counts once, for its first source.
    once = seen.where(F.size("words") > 0).groupBy("h").agg(F.min("source").alias("source"), F.count("*").alias("copies"), F.first("words").alias("words"))
    words = once.select("h", "source", "copies", F.explode("words").alias("word"))
    wrong = garbled_words(words).groupBy("h").agg(F.collect_set(F.struct("word", "right")).alias("wrong"))
    both = seen.select("k", "h", "sequences", "marks").join(wrong, "h", "left")
    both = both.where((F.col("sequences") > 0) | (F.col("marks") > 0) | F.col("wrong").isNotNull())
    return both.groupBy("k").agg(F.max("sequences").alias("sequences"), F.max("marks").alias("marks"), F.array_distinct(F.flatten(F.collect_list("wrong"))).alias("wrong"))


def garbled(documents: DataFrame, ident: str, text: str, source: str | None = None) -> DataFrame:
    """ident of every document that holds a wrongly decoded passage, once each.

    Null, empty and plain ASCII texts are no case. Copies of a text count as one for the counts, repeated rows come
    out once. `source` may name a column that says where a document is from. Other columns are dropped.
    """
    return _judged(documents, ident, text, source).select(F.col("k").alias(ident))


def restored(documents: DataFrame, ident: str, text: str, source: str | None = None) -> DataFrame:
    """ident, sequences, words, restored: the garbled documents with their original.

    sequences and words count what was replaced; the rest of the text is untouched. restored is null where
    characters are lost (U+FFFD), as no decoding brings them back.
    """
    verdict = _judged(documents, ident, text, source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, pairs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                fixed, n = restore_sequences(t)
                swap = {p["word"]: p["right"] for p in pairs or []}
                fixed = WORD.sub(lambda m: swap.get(m[0], m[0]) if not _quoted(m.string, m.start(), m.end()) else m[0], fixed) if swap else fixed
                lost = any(not _quoted(fixed, m.start(), m.end()) for m in re.finditer("�+", fixed))
                out.append((n, len(swap), None if lost else fixed))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())], ["k", "sequences", "words", "restored"])

    both = documents.select(F.col(ident).alias("k"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull()).join(verdict.select("k", "wrong"), "k")
    made = both.mapInArrow(run, f"k {both.schema['k'].dataType.simpleString()}, sequences int, words int, restored string")
    return made.withColumnRenamed("k", ident)
