"""Problem 4: texts that were cut off, by a check of their structure and by how their sources end texts.

A stack automaton reads every text once: quotation marks, brackets, code fences and markup that are still
open at its end, whatever stands there, an escape or a multibyte character that stops half-way, a mark that
someone put behind a cut, or a dangling comma are structural evidence.

What has no terminator may still be complete. There each source's own baseline decides. How likely are the
last words (up to three, names and numbers by their shape) to end a sentence? Complete texts end where
sentences end, cuts fall anywhere; so an unterminated text whose last words end a sentence at rate p speaks
for a cut by r / p, where r is that rate over all words. From these ratios follows, by maximum likelihood,
which share of a source's unterminated texts was cut, and hence its baseline: the share of complete texts
that it leaves without a terminator; lists, whose entries seldom have one, single sentences and longer prose have baselines
of their own. A text is cut if the odds of its source times its own ratio exceed one. A length at
which the source's cut texts pile up while its complete ones don't (a limit in characters, bytes or tokens)
multiplies the odds. A text that is too short for the number of tokens that the model counted, and a last
word that is broken off, count like words that never end a sentence.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.sources import ensure_checkpoint_dir, spread

#: The least rate at which words are taken to end a sentence, for words that never did and for broken ones.
LEAST_RATE = 1e-3
#: Above this rate a last word says nothing by being the beginning of the right answer.
USUAL = 0.9
#: Odds of the words alone from which a text counts for the lengths at which its source cuts.
SURE = 9.0
#: Shares of cut texts among a source's unterminated ones that are tried, and the weight, in texts, of all sources in it.
SHARES, BORROWED = [i / 50 for i in range(1, 50)], 10
#: Complete texts have a narrow range of characters per token (the model's count, taken before a cut) in each script. A text
#: shorter than MARGIN times what all but this SHARE of them reach was cut on its way.
SHARE, MARGIN, LONG = 0.001, 0.95, 40
#: A context that occurs less often than this is replaced by a shorter one.
SEEN = 8
#: Lengths on each side with which one is compared.
NEAR = 10
#: Sums that a task holds before it passes them on.
HELD = 300_000

TERMINATORS = ".!?。！？"
_TERMINATOR_SET = set(TERMINATORS)
#: Last characters that a mark behind a cut has.
_MARK_ENDS = set("])>….�\x7f") | set(map(chr, [*range(9), *range(14, 32)]))
_CLOSERS = "\"'”’»`*)]}」）"
_BEHIND = _CLOSERS + " \n"
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+(?:[-/.'’_:][^\W_぀-ヿ㐀-鿿]+)*(?:[ \xa0]?%)?")
#: The same where all characters are ASCII.
_ASCII_TOKEN = re.compile(r"[0-9A-Za-z]+(?:[-/.'_:][0-9A-Za-z]+)*(?: ?%)?")
_ENDS = re.compile(rf"[{re.escape(_CLOSERS)}\s]*(?:[{TERMINATORS}]|\n|$)")
_CJK, _CYRILLIC = re.compile("[぀-ヿ㐀-鿿]"), re.compile("[а-яё]")
_DIGITS = re.compile(r"\d+")
_HEX = re.compile(r"(?=\w*\d)[0-9a-f]+(?:-[0-9a-f]+)*")
#: Marks behind a cut: a bracketed remark at the very end, dots, a control or replacement character.
_MARK = re.compile(r"(?:\s*[\[<(][^\[\]<>()]{2,40}[\]>)]|…|\.\.\.|[\x00-\x08\x0e-\x1f\x7f�])\s*$")
_REMARK = re.compile(r"\s*[\[<(]([^\[\]<>()]{2,40})[\]>)]\s*$")
_ESCAPE = re.compile(r"(?:\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&#?\w{1,6})$")
_TAGS = re.compile(r"<[^<>]{1,40}>")
_BARE = re.compile(r"\W*(?:[^\W\d_]+:\s*)?\W*$")
_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“", "「": "」", "（": "）"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_WORDS = re.compile(r"\w")
_STRUCT = re.compile(r"```|\*\*|<(/?)(\w+)>|[(\[{“«「（)\]}”»」）`]|(?<!\w)\"(?=\w)|(?<=[\w.!?])\"")


class Remembered(dict):
    """Values of a function of short texts, each computed once; all are forgotten when there are `most`.

    Read as a dictionary, so that a loop over words can be a map. Texts over `length` characters aren't kept.
    """

    def __init__(self, of: Callable[[str], object], most: int = 1 << 16, length: int = 40):
        self.of, self.most, self.length = of, most, length

    def __missing__(self, text: str) -> object:
        value = self.of(text)
        if len(text) <= self.length:
            if len(self) >= self.most:
                self.clear()
            self[text] = value
        return value


def shape(token: str) -> str:
    """What stands for a token in a context: itself in lower case, or the shape of a number, a code, a path or a name."""
    if token[-1] == "%":
        return "9%"
    if token.isdigit():
        return f"9:{len(token)}"
    if "/" in token:
        return "path." + token.rsplit("/", 1)[-1].partition(".")[2]
    if _HEX.fullmatch(token):
        return "hex" + ":".join(str(len(p)) for p in token.split("-"))
    if token[0].isupper():
        return "Name" + ("-9" if _DIGITS.search(token) else "")
    return token


_SHAPES = Remembered(shape)


def _may_open(text: str) -> bool:
    """Whether any character that opens something is in the text."""
    if "`" in text or "*" in text or "<" in text or "(" in text or "[" in text or "{" in text or '"' in text:
        return True
    return not text.isascii() and ("“" in text or "«" in text or "「" in text or "（" in text or "„" in text)


def open_at_end(text: str) -> str:
    """What the stack automaton holds at the end of the text: the openers without a closer, outermost first."""
    if not _may_open(text):
        return ""
    stack: list[str] = []
    for m in _STRUCT.finditer(text):
        s = m[0]
        if stack and stack[-1] == "```" and s != "```":
            continue  # code is not read as prose
        if s in ("```", "**", "`", '"'):
            if s in stack:
                del stack[stack.index(s) :]
            elif s != '"' or not text[max(0, m.start() - 1) : m.start()].strip(" \t\n([{“«„—–-/=:>*"):
                stack.append(s)  # behind a word or a number it can only close, as in 3"
        elif m[2]:
            if m[1] and m[2] in stack:
                del stack[stack.index(m[2]) :]
            elif not m[1]:
                stack.append(m[2])
        elif s in _OPEN:
            stack.append(s)
        elif _CLOSE.get(s) in stack:
            del stack[len(stack) - 1 - stack[::-1].index(_CLOSE[s]) :]
    return " ".join(stack)


def strings(column: pa.Array) -> list[str | None]:
    """The values of a column of strings, faster than to_pylist."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "replace"))


def script(text: str) -> str:
    return "latin" if text.isascii() else "cjk" if _CJK.search(text) else "cyrillic" if _CYRILLIC.search(text) else "latin"


_W, _C, _JOINER, _BLANK, _PER, _TERM, _NEWLINE, _DOT = (1 << i for i in range(8))
#: Characters of a portion; bits of a shape's number.
PORTION, BITS = 1 << 19, 20


@functools.cache
def _classes() -> np.ndarray:
    """What each character is to _TOKEN and to the end of a sentence, as bits."""
    out = np.zeros(0x110000, np.uint8)
    all_ = "".join(map(chr, range(len(out))))
    for bit, of in ((_W, r"[^\W_぀-ヿ㐀-鿿]+"), (_C, r"[぀-ヿ㐀-鿿]+")):
        for m in re.finditer(of, all_):
            out[m.start() : m.end()] |= bit
    for bit, of in ((_JOINER, "-/.'’_:"), (_BLANK, " \xa0"), (_PER, "%"), (_TERM, TERMINATORS), (_NEWLINE, "\n"), (_DOT, ".")):
        out[[ord(c) for c in of]] |= bit
    return out


class Contexts:
    """Counts over texts of their contexts, (three shapes, whether a sentence ended there), and of the words seen in full.

    A text's last token counts only if a terminator follows it: where it stands alone its end is what is asked.
    The tokens are those of _TOKEN, found in many texts at once; a context is the number of its shapes.
    """

    def __init__(self):
        self.known: Counter = Counter()
        self.counts: Counter = Counter()  # those that numbers don't hold
        self.ids = {"#": 0, "^": 1}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def __len__(self) -> int:
        if sum(len(k) for k, _ in self.held) > HELD and len(self.held) > 1:
            keys, at = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
            self.held = [(keys, np.bincount(at, np.concatenate([n for _, n in self.held])).astype(np.int64))]
        return sum(len(k) for k, _ in self.held) + len(self.counts) + len(self.known)

    def add(self, texts: list[str]) -> None:
        part, n = [], 0
        for t in texts:
            part.append(t)
            n += len(t)
            if n >= PORTION:
                self._add(part)
                part, n = [], 0
        if part:
            self._add(part)

    def _add(self, texts: list[str]) -> None:
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        k = _classes()[points]
        stop = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1  # behind each text
        word, single = (k & _W) != 0, (k & _C) != 0
        inside = word.copy()
        inside[1:-1] |= ((k[1:-1] & _JOINER) != 0) & word[:-2] & word[2:]
        begin = np.flatnonzero(inside & ~np.r_[False, inside[:-1]] | single)
        end = np.flatnonzero(inside & ~np.r_[inside[1:], False] | single) + 1
        if not len(begin):
            return
        percent = inside[begin] & ((k[end] & _PER) != 0)
        blank = inside[begin] & ((k[end] & _BLANK) != 0) & ((k[np.minimum(end + 1, len(k) - 1)] & _PER) != 0)
        end += percent + 2 * blank
        of = np.searchsorted(stop, begin)
        first = np.r_[True, of[1:] != of[:-1]]
        last = np.r_[first[1:], True]
        until = np.where(last, stop[of], np.r_[begin[1:], 0])
        upto = lambda x: np.r_[0, np.cumsum(x, dtype=np.int64)]
        n_end, n_term = upto((k & (_TERM | _NEWLINE)) != 0), upto((k & _TERM) != 0)
        ends = n_end[until] > n_end[end]
        dot = (k & _DOT) != 0
        n_dots = upto(dot & np.r_[dot[1:], False] & np.r_[dot[2:], False, False])
        dots = n_dots[np.maximum(until - 2, end)] > n_dots[end]
        keep = ~(last & (dots | (n_term[until] == n_term[end])))

        data, at = joined.encode(), np.stack([begin, end], 1).ravel()
        if len(data) > len(k):
            at = upto(1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF))[at]
        cut = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
        coded = cut.take(pa.array(np.arange(0, len(at) - 1, 2))).dictionary_encode()
        which, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        shapes = [_SHAPES[w] for w in words]
        for w, s, n in zip(words, shapes, np.bincount(which[keep], minlength=len(words)).tolist()):
            if n and s == "Name":
                self.known[w] += n
        if len(self.ids) + len(words) > 1 << BITS:
            self._decode()
        ids = self.ids
        c = np.fromiter((ids.setdefault(s, len(ids)) for s in shapes), np.int64, len(shapes))[which]
        ended = np.r_[False, ends[:-1]]
        b = np.where(first, 0, np.where(ended, 1, np.r_[0, c[:-1]]))
        a = np.where(first, 0, np.where(ended, 1, np.r_[0, b[:-1]]))
        if len(ids) > 1 << BITS:  # of this portion alone
            names = list(ids)
            self.counts.update((names[x], names[y], names[z], e) for x, y, z, e, x_keep in zip(a.tolist(), b.tolist(), c.tolist(), ends.tolist(), keep.tolist()) if x_keep)
            self.ids = {"#": 0, "^": 1}
        else:
            self.held.append(np.unique(((((a << BITS | b) << BITS | c) << 1) | ends)[keep], return_counts=True))

    def _decode(self) -> None:
        """Write the numbers out as shapes."""
        names, some = list(self.ids), (1 << BITS) - 1
        for keys, n in self.held:
            shapes = ([names[i] for i in (keys >> (1 + BITS * p) & some).tolist()] for p in (2, 1, 0))
            for key, x in zip(zip(*shapes, (keys & 1).astype(bool).tolist()), n.tolist()):
                self.counts[key] += x
        self.held, self.ids = [], {"#": 0, "^": 1}

    def take(self) -> tuple[Counter, Counter]:
        """The contexts and the words so far, which are forgotten here."""
        self._decode()
        out = self.counts, self.known
        self.counts, self.known = Counter(), Counter()
        return out


_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})*%[0-9A-Fa-f]{2}%?[0-9A-Fa-f]?$")
_LEAD = re.compile("[\xc2-\xf4][\x80-\xbf]{0,2}$")
_JOINED = re.compile("[\u200d\ud800-\udbff]$")


def broken_bytes(body: str) -> bool:
    """Whether a multibyte character stops half-way at the end: percent-encoded, read byte by byte, or a joined one."""
    if "%" in body and (m := _PERCENT.search(body)):
        try:
            bytes.fromhex(m[0].replace("%", "")[: 2 * m[0].count("%")]).decode()
        except UnicodeDecodeError as e:
            return e.reason == "unexpected end of data"
        except ValueError:
            return True  # half an escape
    if body.isascii():
        return False
    if _JOINED.search(body):
        return True
    m = _LEAD.search(body)
    # The beginning of a longer sequence behind a whole one of the same kind.
    return bool(m) and len(m[0]) < 4 and len(m[0]) < (2 + (m[0][0] >= "\xe0") + (m[0][0] >= "\xf0")) and bool(re.search("[\xc2-\xf4][\x80-\xbf]", body[: m.start()]))


def tail(text: str) -> tuple[str, str, str, str, str, bool]:
    """Evidence of a text's end: (kind, three last shapes, last word, whether a sentence precedes the last one).

    kind: "done" (a terminator and nothing open, or nothing to judge), "bare" (a single value), "cut" or "marked"
    (structural evidence), "open" (no terminator: the source's baseline decides).
    """
    body = text.rstrip()
    marked = False
    if body.endswith("```") and body.count("```") % 2 == 0 or not _WORDS.search(_TAGS.sub("", body) if "<" in body else body):
        return "bare", "", "", "", "", False
    if body[-1:] in _MARK_ENDS:
        while (m := _MARK.search(body)) and m.start() > 0:
            remark = _REMARK.search(body)
            if remark and not re.search("[A-Za-z]", remark[1]):
                break
            marked, body = True, body[: m.start()].rstrip()
    held = open_at_end(body)
    if not held and body.rstrip(_BEHIND)[-1:] in _TERMINATOR_SET:
        return "done", "", "", "", "", False
    tokens = list((_ASCII_TOKEN if body.isascii() else _TOKEN).finditer(body))
    if not tokens:
        return "bare", "", "", "", "", False
    end = body[tokens[-1].end() :]
    rest = end.strip(_BEHIND)
    begin = 0
    for k in range(len(tokens) - 1, 0, -1):
        between = body[tokens[k - 1].end() : tokens[k].start()]
        if any(t in between for t in TERMINATORS) or "\n" in between:
            begin = k
            break
    last = [_SHAPES[t[0]] for t in tokens[max(begin, len(tokens) - 3) :]]
    a, b, c = ((["#", "#"] if begin == 0 else ["^", "^"]) + last)[-3:]
    word = tokens[-1][0]
    if begin == 0 and not marked and not held and _BARE.match(body[: tokens[-1].start()]):
        return "bare", a, b, c, word, begin > 0
    if held and not (marked and rest and rest[-1] in TERMINATORS):
        return "cut", a, b, c, word, begin > 0
    if rest and rest[-1] in TERMINATORS:
        return "done", a, b, c, word, begin > 0
    if rest and rest not in ("%", "°", ";", "}", "-", "=") or ("\\" in body or "&" in body) and _ESCAPE.search(body) or broken_bytes(body):
        return "cut", a, b, c, word, begin > 0  # a comma, a colon, a dash: more was to come
    if end.strip(" \n") in (";", "}", "`;"):
        return "done", a, b, c, word, begin > 0
    return ("marked" if marked else "open"), a, b, c, word, begin > 0


UNITS = ("chars", "bytes", "tokens")
_LIST = re.compile(r"^[ \t]*(?:[-*+•–]|\d{1,3}[.)])[ \t]+\S", re.M)
_SCANNED = ["kind", "a", "b", "c", "word", "part", "style", "chars", "bytes", "tokens", "script", "n", "ends"]


def _scan(rows: DataFrame) -> DataFrame:
    """One pass over all texts (k, source, t, label, tokens): their evidence, and sums of what the corpus says about ends.

    kind "cut", "marked" or "open": a row with the evidence of tail(). "count": n, ends say how often three shapes a, b, c
    occur in a row and end a sentence, with a, or a and b, null by the last two or one. "word": how often a
    capitalised word was seen in full. "ratio": n complete texts of a script have `chars` fiftieths of a character per
    token. "size": n complete texts of a source have `chars` as their length in the unit `word`. Sums are
    added up in each task, so that no text is shuffled.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("k", "source")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, ratios, sizes = Contexts(), Counter(), Counter()
        types: dict[str, pa.DataType] = {}

        def sums() -> pa.RecordBatch:
            counts, known = contexts.take()
            by: dict[tuple, list[int]] = {}
            for (x, y, z, end), n in counts.items():
                for key in ((x, y, z), (None, y, z), (None, None, z)):
                    v = by.setdefault(key, [0, 0])
                    v[0] += n
                    v[1] += n * end
            # source, kind, a, b, c, word, chars, script, n, ends
            out = [(None, "count", *key, None, None, None, *v) for key, v in by.items()]
            out += [(None, "word", None, None, None, w, None, None, n, None) for w, n in known.items()]
            out += [(None, "ratio", None, None, None, None, r, k, n, None) for (k, r), n in ratios.items()]
            out += [(s, "size", None, None, None, u, v, None, n, None) for (s, u, v), n in sizes.items()]
            for c in (ratios, sizes):
                c.clear()
            col = list(zip(*out)) if out else [[]] * 10
            none = [None] * len(out)
            text, int_, long = pa.string(), pa.int32(), pa.int64()
            made = [pa.array(none, types["k"]), pa.array(col[0], types["source"]), *[pa.array(x, text) for x in col[1:6]], pa.array(none, pa.bool_()), pa.array(none, text), pa.array(col[6], int_), pa.array(none, int_), pa.array(none, int_), pa.array(col[7], text), pa.array(col[8], long), pa.array(col[9], long)]
            return pa.RecordBatch.from_arrays(made, ["k", "source", *_SCANNED])

        for b in batches:
            types = {c: b.schema.field(c).type for c in ("k", "source")}
            source, tokens = (b.column(c).to_pylist() for c in ("source", "tokens"))
            label, texts = strings(b.column("label")), strings(b.column("t"))
            got, keep = [], []
            contexts.add(texts)
            for i, t in enumerate(texts):
                g = tail(t)
                if g[0] == "done":
                    sizes[source[i], "chars", len(t)] += 1
                    sizes[source[i], "bytes", _bytes(t)] += 1
                    if (n := tokens[i]) and n > 0:
                        sizes[source[i], "tokens", n] += 1
                        if len(t) >= LONG:
                            ratios[script(t), 50 * len(t) // n] += 1
                elif g[0] != "bare":
                    part = bool(label[i]) and label[i] != g[4] and label[i].startswith(g[4])
                    got.append((*g[:5], part, "list" if _LIST.match(t, t.rstrip().rfind("\n") + 1) else "prose" if g[5] else "single", len(t), _bytes(t), tokens[i], script(t)))
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            col = list(zip(*got)) if got else [[]] * 11
            of = [*[pa.string()] * 5, pa.bool_(), pa.string(), *[pa.int32()] * 3, pa.string()]
            none = pa.array([None] * len(got), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("k").take(at), b.column("source").take(at), *[pa.array(x, k) for x, k in zip(col, of)], none, none], ["k", "source", *_SCANNED])
            if len(contexts) + len(sizes) > HELD:
                yield sums()
        if types:
            yield sums()

    return rows.mapInArrow(run, f"k {kinds['k']}, source {kinds['source']}, kind string, a string, b string, c string, word string, part boolean, style string, chars int, bytes int, tokens int, script string, n bigint, ends bigint")


def _least_ratio(scan: DataFrame) -> DataFrame:
    """script, least: the characters per token below which only SHARE of a script's complete texts lie."""
    rows = scan.where("kind = 'ratio'").groupBy("script", "chars").agg(F.sum("n").alias("n")).select("script", (F.col("chars") / 50).alias("r"), "n")
    by = Window.partitionBy("script")
    upto = F.sum("n").over(by.orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).withColumn("all", F.sum("n").over(by)).where(F.col("upto") >= SHARE * F.col("all")).groupBy("script").agg(F.min("r").alias("least"))


def _scored(scan: DataFrame) -> DataFrame:
    """The tails with p, the rate at which their last words end a sentence (LEAST_RATE for broken ones), r, the rate of all words, and why."""
    counts = scan.where("kind = 'count'").groupBy("a", "b", "c").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    all_ = counts.where("a is null and b is null").agg((F.sum("ends") / F.sum("n")).alias("r"))
    by = counts.where(F.col("n") >= SEEN).withColumn("p", F.col("ends") / F.col("n"))
    three = by.where("a is not null").select("a", "b", "c", F.col("p").alias("p3"))
    two = by.where("a is null and b is not null").select("b", "c", F.col("p").alias("p2"))
    one = by.where("a is null and b is null").select("c", F.col("p").alias("p1"))
    words = scan.where("kind = 'word'").groupBy("word").agg(F.sum("n").alias("n_word"))
    tails = scan.where("kind in ('cut', 'marked', 'open')").select("k", "source", "kind", "a", "b", "c", "word", "part", "style", *UNITS, "script")
    out = tails.join(_least_ratio(scan), "script", "left").join(three, ["a", "b", "c"], "left").join(two, ["b", "c"], "left").join(one, "c", "left").join(words, "word", "left")
    out = out.withColumn("p", F.coalesce("p3", "p2", "p1", F.lit(0.0))).join(F.broadcast(all_))  # one row
    short = F.coalesce((F.col("tokens") > 0) & (F.col("chars") >= LONG) & (F.col("chars") < F.col("tokens") * F.col("least") * MARGIN), F.lit(False))
    name = F.col("c") == "Name"
    # The beginning of the label says little where such an end is usual: a number of another sentence may begin like it.
    broken = F.col("part") & (name | (F.col("p") < USUAL)) | name & F.col("n_word").isNull()
    why = F.when(F.col("kind") != "open", "structure").when(broken, "word").when(short, "length").otherwise("terminator")
    p = F.when(broken | short, LEAST_RATE).otherwise(F.greatest("p", F.lit(LEAST_RATE)))
    return out.select("k", "source", "style", "kind", p.alias("p"), F.greatest(F.coalesce("r", F.lit(0.0)), F.lit(LEAST_RATE)).alias("r"), why.alias("why"), *UNITS)


def _odds(scored: DataFrame) -> DataFrame:
    """source, style, odds: those of a cut for an unterminated text of the source, before its own words are heard.

    The share x that makes the source's ratios likeliest: the sum of ln(x r / p + 1 - x). One row per source and
    logarithmic bin of p is left of the texts before any share is tried; a source of few texts borrows from all.
    """
    bins = scored.where("kind = 'open'").groupBy("source", "style", F.round(8 * F.log("p")).alias("bin")).agg(F.count("*").alias("n"), F.first("r").alias("r"))
    each = bins.withColumn("x", F.explode(F.array(*[F.lit(x) for x in SHARES])))
    term = F.col("n") * F.log(F.col("x") * F.col("r") / F.exp(F.col("bin") / 8) + 1 - F.col("x"))
    own = each.groupBy("source", "style", "x").agg(F.sum(term).alias("own"), F.sum("n").alias("n"))
    everywhere = own.groupBy("style", "x").agg((BORROWED * F.sum("own") / F.sum("n")).alias("borrowed"))
    fit = own.join(everywhere, ["style", "x"]).withColumn("fit", F.col("own") + F.col("borrowed"))
    return fit.groupBy("source", "style").agg(F.max_by("x", F.struct("fit", -F.col("x"))).alias("x")).select("source", "style", (F.col("x") / (1 - F.col("x"))).alias("odds"), "x")


def _limits(sure: DataFrame, scan: DataFrame) -> DataFrame:
    """source, unit, size, gain: the lengths at which a source's cut texts pile up, and by how much they raise the odds.

    n being the number of the source's surely cut texts of that length, less two standard errors, gain is the lesser
    of two ratios: their share over the share of that length among its complete texts, and n over the mean of
    the lengths around it, as a limit is a single length.
    """
    size = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("size")) for u in UNITS]))
    cut = sure.select("source", size.alias("v")).where("v.size > 0").groupBy("source", "v.unit", "v.size").agg(F.count("*").alias("n"))
    full = scan.where("kind = 'size'").groupBy("source", F.col("word").alias("unit"), F.col("chars").alias("size")).agg(F.sum("n").alias("m"))
    both = cut.select("source", "unit", "size", "n", F.lit(0).cast("bigint").alias("m")).unionByName(full.select("source", "unit", "size", F.lit(0).cast("bigint").alias("n"), "m"))
    both = both.groupBy("source", "unit", "size").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    of = Window.partitionBy("source", "unit")
    both = both.withColumn("n_all", F.sum("n").over(of)).withColumn("m_all", F.sum("m").over(of))
    around = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-NEAR, NEAR)
    both = both.withColumn("near", (F.sum("n").over(around) - F.col("n")) / (2 * NEAR))
    many = F.greatest(F.col("n") - 2 * F.sqrt("n"), F.lit(0.0))
    gain = F.least(many / F.col("n_all") * (F.col("m_all") + 1) / (F.col("m") + 1), many / (F.col("near") + 1))
    return both.where("n > 4").withColumn("gain", gain).where("gain > 1").select("source", "unit", "size", "gain")


def _judged(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The unterminated and broken texts (k, source, kind, why, odds) with the final odds of a cut, the odds of the sources, and the scan."""
    # Written once: everything below reads these rows, which hold no texts.
    scan = _scan(rows).checkpoint()
    scored = _scored(scan).checkpoint()
    prior = _odds(scored)
    here = scored.alias("s").join(prior.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.style") == F.col("p.style")), "left").select("s.*", F.coalesce("p.odds", F.lit(1.0)).alias("prior"))
    words = F.col("prior") * F.col("r") / F.col("p")
    structure = F.col("kind") != "open"
    sure = here.where(structure | (words >= SURE))
    out = here.withColumn("words", words)
    # The few lengths of a source that stand out travel as one row of the source.
    at = lambda unit, size: F.concat_ws(" ", unit, size.cast("string"))
    entry = F.struct(at(F.col("unit"), F.col("size")).alias("k"), "gain")
    gains = _limits(sure, scan).groupBy(F.col("source").alias("of")).agg(F.map_from_entries(F.collect_list(entry)).alias("gains"))
    out = out.join(gains, F.col("source").eqNullSafe(F.col("of")), "left")
    gained = [F.lit(1.0), *[F.coalesce(F.try_element_at("gains", at(F.lit(u), F.col(u))), F.lit(1.0)) for u in UNITS]]
    odds = F.when(structure, F.lit(float("inf"))).otherwise(F.col("words") * F.greatest(*gained))
    why = F.when((F.col("why") == "terminator") & (F.col("words") < 1), "limit").otherwise(F.col("why"))
    return out.select("k", "source", "kind", why.alias("why"), odds.alias("odds")), prior, scan


def _texts(df: DataFrame, ident: str, text: str, source: str, label: str, tokens: str) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    t = F.col(text).cast("string")
    rows = df.where(t.isNotNull() & t.rlike(r"\S")).select(F.col(ident).alias("k"), F.col(source).alias("source"), t.alias("t"), F.col(label).cast("string").alias("label"), F.col(tokens).cast("int").alias("tokens"))
    return spread(rows)


def truncated(df: DataFrame, ident: str, text: str, source: str, label: str, tokens: str) -> DataFrame:
    """ident of the rows whose text was cut off inside a word or sentence.

    Null, empty and blank texts, texts of marks or markup alone, bare values and complete texts without a
    final terminator are no case. source may be null: those rows are a source of their own. label (a right
    answer, may be null) shows a last word that is only the beginning of it; tokens (may be null or 0) is
    the model's own count, for limits in tokens. Repeated rows come out as often as they come in. Other
    columns are dropped.
    """
    found, _, _ = _judged(_texts(df, ident, text, source, label, tokens))
    return found.where("odds >= 1").select(F.col("k").alias(ident))


def by_source(df: DataFrame, ident: str, text: str, source: str, label: str, tokens: str) -> DataFrame:
    """How often each source truncates: source, rows, cut, share, baseline, and the cut rows by their evidence.

    baseline is the share of a source's complete texts (prose; bare values left out) that have no terminator.
    by_structure: something open, half an escape or character, a mark or a dangling comma; by_terminator: words
    that hardly end a text of that source; by_limit: they might, but a limit of the source was reached;
    by_word: a word broken off; by_length: too short for the model's tokens. Null texts count as rows.
    """
    found, prior, scan = _judged(_texts(df, ident, text, source, label, tokens))
    kinds = ["structure", "terminator", "limit", "word", "length"]
    n = lambda c: F.count(F.when(c, True))
    cut = F.col("odds") >= 1
    open_ = found.groupBy("source").agg(n(cut).alias("cut"), n(~cut).alias("left"), *[n(cut & (F.col("why") == k)).alias(f"by_{k}") for k in kinds])
    full = scan.where("kind = 'size' and word = 'chars'").groupBy("source").agg(F.sum("n").alias("full"))
    rows = df.groupBy(F.col(source).alias("of")).agg(F.count("*").alias("rows"))
    same = lambda o: F.col("of").eqNullSafe(o["source"])
    out = rows.join(open_, same(open_), "left").drop("source").join(full, same(full), "left").drop("source")
    left, done = F.coalesce("left", F.lit(0)), F.coalesce("full", F.lit(0))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ["cut", *[f"by_{k}" for k in kinds]]]
    baseline = F.when(left + done > 0, left / (left + done))
    return out.select(F.col("of").alias(source), "rows", *counts, (F.coalesce("cut", F.lit(0)) / F.col("rows")).alias("share"), baseline.alias("baseline"))
