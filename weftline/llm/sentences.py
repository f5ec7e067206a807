"""Sentence boundaries across languages and scripts, by semi-Markov dynamic programming over whole spans.

Lines of nothing but white space are certain boundaries; possible ones are runs of end marks with the quotes and brackets that close
there and, beside Thai letters, spaces. A first pass over all documents counts how often an opening word stands at a certain start
and how often after a possible boundary, and the same for closing words and certain ends: an abbreviation stands before
possible boundaries only, a true closing word at certain ends too. It also measures the lengths of units that hold no possible
boundary, and keeps what it found in each text, so that texts are parsed once. The second pass gives each document its best division: a span scores by its opening word, its closing word, its
length, and whether quotations and brackets are closed within it. Nothing is fitted to labels.

All counts stay in one table. Words that make up at least one in 20 000 of their kind, of which there can be no more than 20 000, go to
every task; the counts of the others are joined to the documents that hold them, by a shuffle in which no word can be hot.
"""

from __future__ import annotations

import marshal
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

KEPT = 20_000
_BREAK = re.compile(r"\s*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])[^\S\n\r\x0b\x0c\x85\u2028\u2029]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])\s*")
_SIGN = r"([.!?…。！？؟।॥｡．]+)((?:[\"'”’“」』）)\]\}】》〉]|\s*»)*)"
_MARK = re.compile(_SIGN)
_MARK_OR_GAP = re.compile(_SIGN + r"|(?:(?<=[\u0e01-\u0e5b])|(?<=[\u0e01-\u0e5b][”\"]))\s+(?=\S)|(?<=\S)\s+(?=[\u0e01-\u0e5b])")
_LIST = re.compile(r"\s*(?:[•◦▪*–—-]\s+|(?:\d{1,3}|[^\W\d_])[.)]\s+)+")
_LEAD = re.compile(r"[\s\"'“”‘’„«»「『（(\[{【《¿¡•◦▪–—*-]*")
#: A word with the marks of the scripts that write vowels as marks.
_WORD = re.compile(r"[^\W_](?:[^\W_]|[\u0300-\u036f\u0591-\u05c7\u064b-\u0670\u0900-\u0dff\u0e31-\u0e4e'’](?!\W))*")
_ALNUM = re.compile(r"[^\W_]")
_THAI = re.compile(r"[\u0e01-\u0e5b]")
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_TO_QUOTE = re.compile(r".*[\"'“”‘’„«»「『（(\[{【《¿¡]", re.S)
_QUOTE, _OPEN, _SHUT = set("\"“”„«»「」『』"), set("(（[【{"), set(")）]】}")
_SIGNS = re.compile(r"[\"“”„«»「」『』(（\[【{)）\]】}]")
_SAME = {"｡": "。", "．": "."}
_ENDS = set("\"”’“」』»'")
#: Weights of the model. PLAIN is what a further boundary is worth by its mark.
PLAIN = {".": 1.6, "!": 3.0, "?": 3.0, "…": 2.2, "。": 4.0, "！": 3.5, "？": 3.5, "؟": 3.0, "।": 4.0, "॥": 4.0, " ": 1.2}
LOWER, OPEN_PAIR, GLUED, HOLLOW, ECHO, SMOOTH, FARTHEST = -7.0, -4.5, -0.5, -8.0, -5.0, 4.0, -3.0


def _thai(c: str) -> bool:
    return "\u0e01" <= c <= "\u0e5b"


def _dense(c: str) -> bool:
    return c >= "\u3040" and (c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" or c >= "\U00020000")


@lru_cache(100_000)
def _shape(word: str) -> str:
    if not word:
        return "none"
    if _thai(word[-1]):
        return "thai"
    if _dense(word[-1]):
        return "dense"
    core = word.strip(".")
    if len(core) == 1 and core.isalpha():
        return "one"
    if core.isdigit():
        return "year" if len(core) == 4 else "number"
    if "." in core:
        return "dotted"
    if core[:1].isupper():
        return "Short" if len(core) <= 3 else "Cap"
    if core[:1].islower():
        return "short" if len(core) <= 3 else "low"
    return "short*" if len(core) <= 2 else "other"


def _opening(text: str, at: int, end: int, spaced: bool) -> tuple[str, str]:
    """The opening word at a position, and its shape. spaced: spaces may be boundaries here, so that numbers and names follow possible
    boundaries far more often than elsewhere and are counted apart."""
    if at < end and not text[at].isalnum():
        at = _LEAD.match(text, at, end).end()
    if at >= end:
        word, shape = "", "none"
    else:
        c = text[at]
        if "\u0e01" <= c <= "\u0e5b":
            return text[at : min(at + 5, end)], "thai"
        if c >= "\u3040" and _dense(c):
            word, shape = text[at : min(at + 2, end)], "dense"
        elif not (m := _WORD.match(text, at, end)):
            word, shape = c, "sign"
        elif c.islower():
            word, shape = m[0], "lower"
        elif c.isdigit():
            word, shape = "0", "number"  # which number says nothing
        else:
            word, shape = m[0], "Cap" if c.isupper() else "other"
    return (f"{word}~", f"{shape}~") if spaced else (word, shape)


def _closing(text: str, begin: int, at: int, mark: str, shut: str, spaced: bool) -> tuple[str, str]:
    """The closing word before a mark, with the mark and what closes after it, and their shape."""
    back = 24  # how far to look for the word's start; of scripts without spaces only the last characters count
    while True:
        start = max(begin, at - back)
        rest = text[start:at].rsplit(None, 1)
        if len(rest) > 1 or start == begin or rest and (text[start].isspace() or rest[0][-1] >= "\u0e01" and (_dense(rest[0][-1]) or _thai(rest[0][-1]))):
            break
        back *= 4
    word = rest[-1] if rest else ""
    if not word.isalnum() and (m := _TO_QUOTE.match(word)):
        word = word[m.end() :] or word
    if word and (end := word[-1]) >= "\u0e01":
        word = word[-4:] if _thai(end) else word[-2:] if _dense(end) else word
    sign = mark + ("»" if shut.strip() else "") + "~" * spaced
    return word + sign, _shape(word) + sign


def _closers(text: str, begin: int, at: int, shut: str) -> str:
    """As much of shut as closes: signs that open in one language and close in another close what stands open before."""
    for i, c in enumerate(shut):
        if c == "“" and text.count("„", begin, at) <= text.count("“", begin, at) or c == '"' and text.count('"', begin, at) % 2 == 0:
            return shut[:i].rstrip()
    return shut


class Piece:
    """The possible boundaries of one paragraph: spots[i] = (end of the unit before, start of the unit after).

    marks are the quotes and the depth of brackets before each unit's start and before each unit's end, or None if there are none.
    """

    __slots__ = ("begin", "end", "spots", "close", "open", "kind", "glued", "first", "last", "dense", "quoted", "word_at", "marks")

    def __init__(self, text: str, begin: int, end: int, thai: bool, dense: bool) -> None:
        self.begin, self.end = begin, end
        self.spots, self.close, self.open, self.kind, self.glued = spots, close, open_, kind, glued = [], [], [], [], []
        at = (m.end() if (m := _LIST.match(text, begin, end)) else begin)
        final = None
        thai = thai and bool(_THAI.search(text, begin, end))
        for m in (_MARK_OR_GAP if thai else _MARK).finditer(text, at, end):
            mark, shut = m.groups()
            if mark is None:
                a, b = m.span()
                mark, shut, word_end = " ", "", a
            else:
                word_end, a = m.start(), m.end(1)
                if shut:
                    shut = _closers(text, begin, word_end, shut)
                    a += len(shut)
                mark = "…" if mark[-1] == "…" or mark.endswith("..") else mark[-1]
                mark = _SAME.get(mark, mark)
                if a >= end:
                    final = (word_end, mark, shut)
                    break
                b = a
                while text[b].isspace():
                    b += 1
                if b == a and mark in ".!?…" and not shut and (text[b].isdigit() or text[b].islower() or text[b] in ",;:"):
                    continue
            spots.append((a, b))
            close.append(_closing(text, begin, word_end, mark, shut, thai))
            open_.append(_opening(text, b, end, thai))
            kind.append(mark)
            glued.append(b == a and mark in ".!?…")
        self.first = _opening(text, begin, end, thai)
        if final:
            self.last = _closing(text, begin, *final, thai)
        else:
            self.last = _closing(text, begin, end, " ", "", thai)
        self.dense = thai or dense and bool(_DENSE.search(text, begin, end))
        if self.spots:
            self.quoted = [text[a - 1] in _ENDS for a, _ in self.spots]
            # where within eight characters of a unit's start its first letter or digit stands
            self.word_at = [m.start() if (m := _ALNUM.search(text, b, min(b + 8, end))) else b + 8 for b in (begin, *(b for _, b in self.spots))]
            self.marks = self._marks(text)

    def _marks(self, text: str) -> tuple | None:
        signs = [(m.start(), m[0]) for m in _SIGNS.finditer(text, self.begin, self.end)]
        if not signs:
            return None
        ends, starts, seen, q, d, at = [a for a, _ in self.spots] + [self.end], [self.begin] + [b for _, b in self.spots], {}, 0, 0, 0
        for edge in sorted({*ends, *starts}):
            while at < len(signs) and signs[at][0] < edge:
                if signs[at][1] in _QUOTE:
                    q += 1
                else:
                    d += 1 if signs[at][1] in _OPEN else -1
                at += 1
            seen[edge] = q, d
        return [seen[x] for x in starts], [seen[x] for x in ends]

    def kept(self) -> tuple:
        """What a division needs, in plain values."""
        if not self.spots:
            return self.begin, self.end
        return (self.begin, self.end, self.dense, self.last, [a for a, _ in self.spots], [b for _, b in self.spots], self.close, self.open, self.kind, self.glued, self.quoted, self.word_at, self.marks)


def pieces(text: str) -> Iterator[Piece]:
    at, thai, dense = 0, False, False
    if not text.isascii():
        thai, dense = bool(_THAI.search(text)), bool(_DENSE.search(text))
    for m in [*_BREAK.finditer(text), None]:
        begin, end = at, m.start() if m else len(text)
        at = m.end() if m else at
        while begin < end and text[begin].isspace():
            begin += 1
        while end > begin and text[end - 1].isspace():
            end -= 1
        if begin < end:
            yield Piece(text, begin, end, thai, dense)


class Counts:
    """What texts say, by (word, shape): open and close at certain starts and ends (1) and at possible ones (0), closing words after a
    quotation, and the rounded log lengths of units that hold no possible boundary. What a paragraph says n times weighs 1 + log2 n, in
    sixteenths, so that one that says the same thousands of times doesn't outweigh all others."""

    def __init__(self) -> None:
        self.words = {(kind, sure): defaultdict(int) for kind in "oc" for sure in (0, 1)}
        self.after, self.lengths = defaultdict(int), defaultdict(int)

    def __len__(self) -> int:
        return sum(map(len, (*self.words.values(), self.after, self.lengths)))

    def add(self, text: str) -> tuple[list[str], list[tuple]]:
        """Counts a text; returns its own words, each after its kind (o or c), and its pieces."""
        own, parsed, words = set(), [], self.words
        for p in pieces(text):
            parsed.append(p.kept())
            own.update(("o" + p.first[0], "c" + p.last[0]))
            words["o", 1][p.first] += 16
            words["c", 1][p.last] += 16
            if not p.spots:
                if p.end - p.begin > 3:
                    self.lengths[f"{int(p.dense)} {round(4 * math.log(p.end - p.begin))}"] += 16
                continue
            for kind, held in (("o", p.open), ("c", p.close)):
                own.update([kind + x[0] for x in held])
                self._weigh(words[kind, 0], held)
            if any(p.quoted):
                self._weigh(self.after, [x[0] for x, shut in zip([*p.close[1:], p.last], p.quoted) if shut])
        return [*own], parsed

    @staticmethod
    def _weigh(into: dict, held: list) -> None:
        if len({*held}) == len(held):
            for x in held:
                into[x] += 16
        else:
            for x, n in Counter(held).items():
                into[x] += round(16 * (1 + math.log2(n)))

    def rows(self) -> tuple[list, list, list, list, list]:
        """(kind, key, sure, other, after): o and c for words, O and C for their shapes, L for lengths."""
        out = defaultdict(lambda: [0, 0, 0])
        for (kind, sure), held in self.words.items():
            for (word, shape), n in held.items():
                out[kind, word][1 - sure] += n
                out[kind.upper(), shape][1 - sure] += n
        for word, n in self.after.items():
            out["c", word][2] += n
        for size, n in self.lengths.items():
            out["L", size][0] += n
        return tuple([*x] for x in zip(*((*k, *v) for k, v in out.items()))) or ([],) * 5


def _row() -> Column:
    """What joins a document to its words' counts; only exact copies share one, and should hashes meet, both texts get the words of both."""
    return F.xxhash64("doc_id", "text").alias("row")


def statistics(documents: DataFrame, held: int = 200_000) -> tuple[dict, DataFrame, DataFrame]:
    """The counts over all documents: those of shapes, lengths and frequent words as a bounded table on the driver, (row, told) with
    the counts of a document's other words, and (row, doc_id, parsed) with the pieces of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        names = ["row", "doc_id", "parsed", "words", "kind", "key", "sure", "other", "after"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

        def batch(n: int, **columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names)

        def flush() -> pa.RecordBatch:
            kind, key, sure, other, after = counts.rows()
            return batch(len(kind), kind=kind, key=key, sure=sure, other=other, after=after)

        for b in batches:
            row, doc, words, parsed = [], [], [], []
            for at, name, text in zip(*(c.to_pylist() for c in b.columns)):
                if text:
                    row.append(at)
                    doc.append(name)
                    own, kept = counts.add(text)
                    words.append(own)
                    parsed.append(marshal.dumps(kept))
                    if len(counts) > held:
                        yield flush()
                        counts = Counts()
            yield batch(len(row), row=row, doc_id=doc, words=words, parsed=parsed)
        yield flush()

    schema = "row bigint, doc_id bigint, parsed binary, words array<string>, kind string, key string, sure bigint, other bigint, after bigint"
    found = cut(documents.select(_row(), F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema))
    each = found.where("kind IS NOT NULL").groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in ("sure", "other", "after")])
    each = cut(each.withColumn("n", F.col("sure") + F.col("other")))
    least = F.lit(0.0)  # there are few shapes and lengths
    for kind, total in each.where("kind IN ('o', 'c')").groupBy("kind").agg(F.sum("n")).collect():
        least = F.when(F.col("kind") == kind, total / KEPT).otherwise(least)
    frequent = each.where(F.col("n") >= least)
    table: dict = {}
    for kind, key, sure, other, after in frequent.drop("n").collect():  # at most KEPT of each kind of word
        table.setdefault(kind, {})[key] = (sure / 16, other / 16, after / 16)
    word = F.concat("kind", "key").alias("word")
    own = found.where("row IS NOT NULL").select("row", F.explode("words").alias("word"))
    own = own.join(F.broadcast(frequent.where("kind IN ('o', 'c')").select(word)), "word", "left_anti").dropDuplicates(["row", "word"])
    told = own.join(each.where(F.col("n") < least).select(word, "sure", "other", "after"), "word")
    told = told.groupBy("row").agg(F.collect_list(F.struct("word", "sure", "other", "after")).alias("told"))  # as many as the text has
    return table, told, found.where("row IS NOT NULL").select("row", "doc_id", "parsed")


class Model:
    """Log scores of opening words, closing words and lengths from the counts; told: those of the text at hand that table lacks."""

    def __init__(self, table: dict) -> None:
        self.rate, self.seen = {}, {}
        for words, shapes in (("o", "O"), ("c", "C")):
            held = table.get(shapes, {})
            sure, other = (sum(v[i] for v in held.values()) for i in (0, 1))
            base = (sure + 1) / (sure + other + 2)
            rates = {k: (s + 2 * base) / (s + o + 2) for k, (s, o, _) in held.items()}
            self.rate[words] = (base, rates)
            self.seen[words] = table.get(words, {})
        self.told: dict = {}
        self.size = {}
        for dense in (0, 1):
            held = [(int(k.split()[1]) / 4, v[0]) for k, v in table.get("L", {}).items() if k.startswith(f"{dense} ")]
            n, guess = sum(v for _, v in held) + 10, 3.3 if dense else 4.2  # as if ten units of ordinary length had been seen
            mean = (sum(x * v for x, v in held) + 10 * guess) / n
            var = (sum((x - mean) ** 2 * v for x, v in held) + 10) / n
            self.size[bool(dense)] = (mean, var)
        self.lengths = {d: [self._length(d, n) for n in range(2000)] for d in (False, True)}
        self.known: dict = {}

    def counts(self, kind: str, word: str) -> tuple[float, float, float]:
        return self.seen[kind].get(word) or self.told.get(kind + word, (0, 0, 0))

    def word(self, kind: str, key: tuple[str, str]) -> float:
        score = self.known.get((kind, *key))
        if score is None:
            base, rates = self.rate[kind]
            prior = rates.get(key[1], base)
            sure, other, _ = self.counts(kind, key[0])
            score = math.log((sure + SMOOTH * prior) / (sure + other + SMOOTH) / base)
            if len(self.known) < 200_000:
                self.known[(kind, *key)] = score
        return score

    def length(self, dense: bool, n: int) -> float:
        held = self.lengths[dense]
        return held[n] if n < len(held) else self._length(dense, n)

    def _length(self, dense: bool, n: int) -> float:
        mean, var = self.size[dense]
        return max(FARTHEST, -0.25 * (math.log(max(n, 1)) - mean) ** 2 / var)

    def echo(self, last: tuple[str, str]) -> bool:
        """Whether this closing word stands after quotations nearly always, as that of 'he asked' does."""
        sure, other, after = self.counts("c", last[0])
        return sure + other >= 4 and after > 0.6 * (sure + other)

    def divide(self, parsed: list[tuple], told: dict) -> list[tuple[int, int]]:
        self.told = told
        out: list[tuple[int, int]] = []
        for p in parsed:
            if len(p) == 2:
                out.append(p)
            else:
                out += self._best(*p)
        return out

    def _best(self, begin: int, end: int, dense: bool, closing: tuple, ends: list, starts: list, close: list, open_: list, kinds: list, glued: list, shut: list, word_at: list, marks: tuple | None) -> list[tuple[int, int]]:
        word = self.word
        # what each boundary gains
        gain = [
            PLAIN.get(kind, 1.6) + (LOWER if key[1].startswith("lower") else word("o", key)) + word("c", last) + (GLUED if tight else 0)
            for kind, key, last, tight in zip(kinds, open_, close, glued)
        ]
        ends, starts, last = ends + [end], [begin] + starts, close + [closing]
        n = len(ends)
        after, upto = marks or ([(0, 0)] * n, [(0, 0)] * n)  # signs before a unit's start and end
        quoted = [False] + shut
        best, back = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        size, most = self.lengths[dense], len(self.lengths[dense])
        base = [0.0] * (n + 1)  # the best score up to a start, with what its boundary gains
        peak = [0.0] * (n + 1)  # the highest base up to a start; no length scores above 0
        # starts so far back that length says no more: the highest base, by whether quoted and whether a quotation is open, then by depth
        far: dict = {}
        near = 0
        for j in range(n):
            end, (q, d), echo = ends[j], upto[j], self.echo(last[j])
            top, arg = -math.inf, 0
            while near < j and end - starts[near] >= most:
                before, deep = after[near]
                for key in ((quoted[near], before & 1), (quoted[near], before & 1, deep)):
                    if key not in far or base[near] >= far[key][0]:
                        far[key] = base[near], near
                near += 1
            for i in range(j, near - 1, -1):
                if peak[i] <= top:
                    break
                k = end - starts[i]
                s = base[i] + (size[k] if k < most else FARTHEST)
                before, deep = after[i]
                if (q - before) & 1:
                    s += OPEN_PAIR
                if d != deep:
                    s += OPEN_PAIR
                if echo and quoted[i]:
                    s += ECHO
                if k < 8 and word_at[i] >= end:
                    s += HOLLOW
                if s > top:
                    top, arg = s, i
            if near and peak[near - 1] + FARTHEST > top:
                for closed in (False, True):
                    for odd in (0, 1):
                        for key, s in (((closed, odd), OPEN_PAIR), ((closed, odd, d), 0.0)):
                            if key in far:
                                s += far[key][0] + FARTHEST + (OPEN_PAIR if (q - odd) & 1 else 0.0) + (ECHO if echo and closed else 0.0)
                                if s > top:
                                    top, arg = s, far[key][1]
            best[j + 1], back[j + 1] = top, arg
            if j + 1 < n:
                base[j + 1] = top + gain[j]
                peak[j + 1] = max(peak[j], base[j + 1])
        out, j = [], n
        while j:
            i = back[j]
            out.append((starts[i], ends[j - 1]))
            j = i
        return out[::-1]


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char): the units of every document, from the first character that isn't white space to just after the
    last. A null or blank text has none; documents without an id, or in several copies, keep their rows as they are."""
    table, told, parsed = statistics(documents)
    model = documents.sparkSession.sparkContext.broadcast(Model(table))
    fields = ("word", "sure", "other", "after")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            row, start, end = [], [], []
            for i, (kept, *lists) in enumerate(zip(b.column("parsed").to_pylist(), *(b.column(c).to_pylist() for c in fields))):
                rare = {w: (x / 16, y / 16, z / 16) for w, x, y, z in zip(*lists)} if lists[0] else {}
                units = m.divide(marshal.loads(kept), rare)
                row += [i] * len(units)
                start += [x for x, _ in units]
                end += [x for _, x in units]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["doc_id", "start_char", "end_char"])

    texts = parsed.join(told, "row", "left")
    return texts.select("doc_id", "parsed", *[F.col("told")[c].alias(c) for c in fields]).mapInArrow(run, "doc_id bigint, start_char int, end_char int")
