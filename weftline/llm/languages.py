"""Languages of documents and of the parts of mixed ones, by rank-order n-gram profiles.

A language's profile is the ranking of its most frequent character n-grams in the samples. A part's own n-grams are ranked by
frequency too, and the language whose profile is nearest wins: the distance sums, over the part's n-grams, how far the two ranks
are out of place; an n-gram that a profile lacks counts as far as possible. All parts of a batch are ranked at once in numpy, so the work is a map over the rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .langnames import names, parse

GRAMS = (3, 4)
TOP = 3000
ABSENT = 6000
OFTEN = 0.002
NEARLY = 1.15
_CLUTTER = re.compile(r"[\[【{<♪*(（\d]|-->")
_NOISE = re.compile(r"\[[^\]]*\]|【[^】]*】|\{[^}]*\}|<[^>]*>|♪[^♪]*♪|\*[^*]+\*|[(（][^()（）.!?。！？]*[)）]|-->|\d+(?:[:.,]\d+)*")
_PART = re.compile(r"[^.!?…。！？؟।॥\n]+[.!?…。！？؟।॥]*[\"'”’»」』）)]*")
_HEAD = re.compile(r"\s*(?:[^\W\d_a-z][\w'’.]*\s+){0,3}[^\W\d_a-z][\w'’.]*\s*[:：]\s+")
_FOREIGN = re.compile(r"[\u0370-\u1dff\u2c80-\ua71f\ua800-\uaaff\uac00-\ud7ff\uf900-\ufaff\ufb1d-\ufdff\ufe70-\ufefe\uff66-\uffdc\U00010000-\U0003ffff]")
_LATIN = re.compile(r"[A-Za-zª-\u024f\u1e00-\u1eff][\w'’\u0300-\u036f]*")
_RUN = re.compile(r"(?:[A-Za-zÀ-\u024f][A-Za-zÀ-\u024f\u0300-\u036f'’]*[\s,;:-]*){3,}")
_PLAIN_OTHER = re.compile(r"[\W\d_]+")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")

#: Hesitations of the languages; they are in no language. Fixed values.
HESITATIONS = frozenset("eh em este mmm mm er uh um hmm hm hum hã ha ahn ah euh heu äh ähm ahm э эм мм えーと あのー うーん 呃 嗯 唔 آه ممم अम्म उम्म हम्म เอ่อ อืม".split())


def _letters(piece: str) -> tuple[str, bool]:
    """The words of a part in lower case, hesitations left out, and whether they are in another script than Latin."""
    if piece.isascii():
        words, foreign = _PLAIN_OTHER.sub(" ", piece.lower()), False
    else:
        piece = unicodedata.normalize("NFC", piece)
        marks = _FOREIGN.findall(piece)
        foreign = bool(marks)
        if foreign:
            if len(marks) >= 4 or len(marks) >= sum(map(len, _LATIN.findall(piece))):
                piece = _LATIN.sub(" ", piece)
            words = _OTHER.sub(" ", piece.lower())
        else:
            words = _PLAIN_OTHER.sub(" ", piece.lower())
    return " ".join([w for w in words.split() if w not in HESITATIONS]), foreign


def _says_more(words: list[str]) -> bool:
    """Whether Latin words are more than a name, even one that is begun twice."""
    capital = {w.lower() for w in words if not w[0].islower()}
    return len({w for w in words if w[0].islower()} - capital) > 1


def parts(text: str) -> list[tuple[int, int, str]]:
    """(start, end, letters): the sentences of a text as far as languages need them, sounds, clocks, numbers and names that head it
    left out. What stands between marks but is too short to be told, as after an abbreviation, joins what follows."""
    bare = _NOISE.sub(lambda m: " " * len(m[0]), text) if _CLUTTER.search(text) else text
    begin = m.end() if (":" in bare or "：" in bare) and (m := _HEAD.match(bare)) else 0
    out: list[list] = []
    small = False
    for m in _PART.finditer(bare, begin):
        a, b = m.span()
        cuts = [(a, b)]
        if not (s := m[0]).isascii() and _FOREIGN.search(s):
            # Latin words in a row beside another script are a sentence of their own, unless they are names
            runs = [r.span() for r in _RUN.finditer(s) if _says_more(_LATIN.findall(r[0]))]
            if runs:
                edges = sorted({0, len(s), *(x for r in runs for x in r)})
                cuts = [(a + x, a + y) for x, y in zip(edges, edges[1:])]
        for a, b in cuts:
            letters, foreign = _letters(bare[a:b])
            if not letters:
                continue
            if small:
                out[-1][1:] = b, f"{out[-1][2]} {letters}"
            else:
                out.append([a, b, letters])
            small = not foreign and len(out[-1][2]) < 8
    if small and len(out) > 1:
        out[-2][1:] = out[-1][1], f"{out[-2][2]} {out[-1][2]}"
        out.pop()
    return [tuple(x) for x in out]


def _words(letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all parts with a space around every word, and the part that each belongs to."""
    spaced = [f" {x} " for x in letters]
    code = np.frombuffer("".join(spaced).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return code, np.repeat(np.arange(len(spaced)), [len(x) for x in spaced])


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(code: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all n-grams within words, their padding included, with their owners."""
    with np.errstate(over="ignore"):
        space = code == 32
        h = code * _MIX
        inner = np.zeros(len(code), bool)  # a space inside the n-gram
        for n in range(2, GRAMS[-1] + 1):
            if len(code) < n:
                return
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _MIX + code[n - 1 :] * np.uint64(0xD6E8FEB86659FD93)
            inner = inner[:-1] | (space[n - 2 : len(code) - 1] if n > 2 else False)
            if n < GRAMS[0]:
                continue
            good = ~inner & (owner[: len(h)] == owner[n - 1 :])
            yield h[good], owner[: len(h)][good]


class Profiles:
    """The languages' profiles as one table: rank[n-gram, language], found by hash."""

    BITS = 21

    def __init__(self, samples: list[tuple[str, str]], more: dict[str, list[str]] | None = None) -> None:
        """samples: correct (lang, text); more: parts that are labelled, mostly rightly, so only n-grams that they hold often count."""
        self.codes = sorted({lang for lang, _ in samples})
        ranks: dict[int, dict[int, int]] = {}
        weight: Counter = Counter()
        for at, lang in enumerate(self.codes):
            counts = self._counts([x for code, text in samples if code == lang for _, _, x in parts(text)])
            extra = (more or {}).get(lang, [])
            for h, n in self._counts(extra).items():
                if h in counts or n >= max(2, OFTEN * len(extra)):
                    counts[h] += n
            for r, (h, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TOP]):
                ranks.setdefault(h, {})[at] = r
                weight[h] += n
        order = sorted(ranks, key=lambda h: (-weight[h], h))
        self.hash = np.array(order or [0], np.uint64)
        self.rank = np.full((len(self.hash), len(self.codes)), TOP, np.int16)
        for i, h in enumerate(order):
            for at, r in ranks[h].items():
                self.rank[i, at] = r
        self.slot = np.full(2**self.BITS, -1, np.int32)
        # n-grams that share a slot form a chain
        self.chain = np.full(len(self.hash), -1, np.int32)
        for i, at in reversed([*enumerate((self.hash >> np.uint64(64 - self.BITS)).tolist())]):
            self.chain[i], self.slot[at] = self.slot[at], i

    @staticmethod
    def _counts(letters: list[str]) -> Counter:
        out: Counter = Counter()
        for h, _ in _hashes(*_words(letters)) if letters else ():
            out.update(h.tolist())
        return out

    def judge(self, letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each part its language's number, -1 if no profile shares an n-gram, and all distances per n-gram."""
        n, k = len(letters), len(self.codes)
        found, owners = [], []
        for h, owner in _hashes(*_words(letters)) if n else ():
            at = self.slot[(h >> np.uint64(64 - self.BITS)).astype(np.int64)]
            while len(hit := np.flatnonzero(at >= 0)):
                at, h, owner = at[hit], h[hit], owner[hit]
                same = self.hash[at] == h
                found.append(at[same])
                owners.append(owner[same])
                at, h, owner = self.chain[at[~same]], h[~same], owner[~same]
        best, mean = np.full(n, -1), np.full((n, k), float(ABSENT))
        if not found or not sum(map(len, found)):
            return best, mean
        key = np.concatenate(owners).astype(np.int64) << 24 | np.concatenate(found)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        owner, gram = key[first] >> 24, key[first] & (2**24 - 1)
        # by part, then frequency, then the n-gram's own standing
        most = int(count.max())
        if n * (most + 1) * len(self.hash) < 2**62:  # as one number, which sorts quicker
            key = (owner * (most + 1) + most - count) * len(self.hash) + gram
            key.sort()
            gram, owner = key % len(self.hash), key // len(self.hash) // (most + 1)
        else:
            order = np.lexsort((gram, -count, owner))
            owner, gram = owner[order], gram[order]
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = np.diff(np.append(begin, len(owner)))
        place = np.arange(len(owner)) - np.repeat(begin, size)
        far = np.abs(self.rank[gram] - np.minimum(place, TOP).astype(np.int16)[:, None])
        far[self.rank[gram] == TOP] = ABSENT
        total = np.add.reduceat(far, begin, axis=0, dtype=np.int32)
        who = owner[begin]
        mean[who] = total / size[:, None]
        best[who] = mean[who].argmin(1)
        return best, mean


def profiles(samples: DataFrame, labelled: DataFrame, most: int = 2500) -> Profiles:
    """Profiles from a small table of correct samples (lang, text), which is collected whole, and from at most `most` rows per language
    of labelled (talk_id, source_line, lang, text), drawn by the hash of their key, of which those of one part are used."""
    rows = samples.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").collect()
    codes = sorted({r[0] for r in rows})
    own = labelled.select(F.lower("lang").alias("lang"), "text", F.xxhash64("talk_id", "source_line").alias("_h")).where(F.col("lang").isin(codes) & F.col("text").isNotNull())
    # first the least of each of 64 parts of a language, among which the least of all are, so that no task sorts a whole language
    own = own.withColumn("_part", F.pmod(F.col("_h"), F.lit(64))).withColumn("_r", F.row_number().over(W.partitionBy("lang", "_part").orderBy("_h", "text"))).where(F.col("_r") <= most)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("_h", "text"))
    more: dict[str, list[str]] = {}
    for lang, text in own.withColumn("_r", rank).where(F.col("_r") <= most).select("lang", "text").collect():  # the bounded sample
        if len(found := parts(text)) == 1:
            more.setdefault(lang, []).append(found[0][2])
    return Profiles([(r[0], r[1]) for r in rows], more)


def _judged(p: Profiles, texts: list[str | None], told: list[list[str]]) -> Iterator[tuple[int, int, int, str | None, float]]:
    """(row, start, end, lang, confidence) for the parts of texts; a language that the row names wins where it is nearly as near.

    The confidence is the distance to the nearest other language as a share of that and the distance to the one given: 1 where they
    are one, a half where the two are equally near, less where a named language wins over a nearer one. A part that shares no n-gram with any profile
    has no language and confidence 0.
    """
    row, start, end, letters = [], [], [], []
    for i, text in enumerate(texts):
        for s, e, x in parts(text) if text else ():
            row.append(i)
            start.append(s)
            end.append(e)
            letters.append(x)
    best, mean = p.judge(letters)
    two = np.sort(mean, axis=1)[:, :2].tolist() if len(p.codes) > 1 else None
    number = {c: i for i, c in enumerate(p.codes)}
    for j, i in enumerate(row):
        b = best[j]
        if b < 0:
            yield i, start[j], end[j], None, 0.0
            continue
        for c in told[i]:
            k = number.get(c, b)
            if k != b and mean[j, k] <= NEARLY * mean[j, b]:
                b = k
                break
        own = float(mean[j, b])
        other = two[j][1] if two and b == best[j] else two[j][0] if two else own
        yield i, start[j], end[j], p.codes[b], 1.0 if not two or other + own == 0 else other / (other + own)


def _talk_lines(talks: DataFrame) -> DataFrame:
    """(talk_id, source_line 0, at, text, lang): the lines of the talks' texts with their offsets; a task splits, others judge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for talk, text, lang in zip(*(b.column(c).to_pylist() for c in ("talk_id", "text", "lang"))):
                lines, at, now = text.split("\n"), [], 0
                for x in lines:
                    at.append(now)
                    now += len(x) + 1
                n = len(lines)
                yield pa.RecordBatch.from_arrays([pa.array([talk] * n, pa.string()), pa.array([0] * n, pa.int32()), pa.array(at, pa.int32()), pa.array(lines, pa.string()), pa.array([lang] * n, pa.string())], ["talk_id", "source_line", "at", "text", "lang"])

    texts = talks.where("text IS NOT NULL").select("talk_id", "text", F.array_join("languages", ";").alias("lang"))
    lines = texts.mapInArrow(run, "talk_id string, source_line int, at int, text string, lang string")
    return lines.where("trim(text) != ''").repartition("talk_id", "at")


def label_parts(utterances: DataFrame, talks: DataFrame, samples: DataFrame, size: int = 4000) -> DataFrame:
    """(talk_id, source_line, start_char, end_char, lang, confidence): every part of an utterance's text and, with source_line 0, of a
    talk's text that holds words besides sounds, names that head a line and hesitations. Repeated rows count once, null and wordless
    texts have no row."""
    spark = utterances.sparkSession
    p = profiles(samples, utterances)
    model, table = spark.sparkContext.broadcast(p), names(spark, p.codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for whole in batches:
            for off in range(0, len(whole), size):
                b = whole.slice(off, size)
                told = [seen[x] if x in seen else seen.setdefault(x, parse(x, table)) for x in b.column("lang").to_pylist()]
                at = b.column("at").to_pylist()
                out = [*zip(*((i, at[i] + s, at[i] + e, code, sure) for i, s, e, code, sure in _judged(model.value, b.column("text").to_pylist(), told)))] or [[]] * 5
                take = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("talk_id").take(take), b.column("source_line").take(take), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()), pa.array(out[4], pa.float64())], ["talk_id", "source_line", "start_char", "end_char", "lang", "confidence"])

    schema = "talk_id string, source_line int, start_char int, end_char int, lang string, confidence double"
    spoken = utterances.select("talk_id", "source_line", F.lit(0).alias("at"), "text", "lang")
    return spoken.unionByName(_talk_lines(talks)).mapInArrow(run, schema).distinct()


def row_languages(utterances: DataFrame, talks: DataFrame, samples: DataFrame, share: float = 0.0) -> DataFrame:
    """(talk_id, source_line, lang, confidence, named): every language an utterance is in, with its best confidence and whether the
    utterance's lang names it; with source_line 0 every language of a talk's text, if at least that share of its lines is in it.

    Every utterance and talk has a row: one in no language that the profiles know, as one of null text, has a null language and confidence 0.
    """
    found = _line_languages(utterances, talks, samples, share)
    none = F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("named")
    blank = utterances.where("text IS NULL OR trim(text) = ''").select("talk_id", "source_line", *none)
    blank = blank.unionByName(talks.where("text IS NULL").select("talk_id", F.lit(0).alias("source_line"), *none)).distinct()
    return found.drop("n", "lines").unionByName(blank)


def talk_languages(utterances: DataFrame, talks: DataFrame, samples: DataFrame, share: float = 0.1) -> DataFrame:
    """(talk_id, language): the languages that at least that share of a talk's lines is in, sorted and joined by '+'; talks in none are left
    out. The utterances only lend their labelled texts to the profiles."""
    found = _line_languages(utterances, talks, samples, share, judged=False).where("lang IS NOT NULL")
    return found.groupBy("talk_id").agg(F.array_join(F.array_sort(F.collect_set("lang")), "+").alias("language"))  # as many as there are profiles


def unnamed_languages(utterances: DataFrame, talks: DataFrame, samples: DataFrame, share: float = 0.1) -> DataFrame:
    """(talk_id, source_line, lang): the languages of utterances and, with source_line 0, those of at least that share of the lines of
    talks, that their labels don't name."""
    return _line_languages(utterances, talks, samples, share).where("NOT named AND lang IS NOT NULL").select("talk_id", "source_line", "lang")


def _line_languages(utterances: DataFrame, talks: DataFrame, samples: DataFrame, share: float, size: int = 4000, judged: bool = True) -> DataFrame:
    """row_languages of the texts that aren't null or blank, with n, the lines in the language, and lines, all of them; judged: of utterances too.

    Lines go to tasks by talk and text: the line of a talk's text and the utterance it comes from meet in one task and are judged
    once, and neither a long talk nor a frequent line burdens one task.
    """
    spark = utterances.sparkSession
    p = profiles(samples, utterances)
    model, table = spark.sparkContext.broadcast(p), names(spark, p.codes)
    spoken = utterances.select("talk_id", "source_line", "text", "lang").where("text IS NOT NULL AND trim(text) != ''")
    # a talk's repeated row doubles all its lines, which leaves their shares as they are
    texts = talks.where("text IS NOT NULL").select("talk_id", "text", F.array_join("languages", ";").alias("lang"))
    lines = texts.select("talk_id", F.lit(0).alias("source_line"), F.explode(F.split("text", "\n")).alias("text"), "lang")
    both = (spoken.unionByName(lines) if judged else lines).hint("rebalance", "talk_id", "text").sortWithinPartitions("talk_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for whole in batches:
            for off in range(0, len(whole), size):
                b = whole.slice(off, size)
                talk, lang, text, line = (b.column(c).to_pylist() for c in ("talk_id", "lang", "text", "source_line"))
                told = [seen[x] if x in seen else seen.setdefault(x, parse(x, table)) for x in lang]
                # equal lines stand together: the first one's judgement holds for all that follow
                first, whose = [], []
                for i, x in enumerate(text):
                    if not i or x != text[i - 1]:
                        first.append(i)
                    whose.append(len(first) - 1)
                names_ = [[*dict.fromkeys(c for i in range(first[k], first[k + 1] if k + 1 < len(first) else len(text)) for c in told[i])] for k in range(len(first))]
                found: list[dict[str, float]] = [{} for _ in first]
                for k, _, _, code, sure in _judged(model.value, [text[i] for i in first], names_):
                    if code is not None:
                        found[k][code] = max(sure, found[k].get(code, 0.0))
                # utterances give a row per language, a talk's lines are summed up here as far as they are at hand
                sums: dict[tuple, list] = {}
                for i, k in enumerate(whose):
                    many = found[k].items() or [(None, 0.0)]
                    for code, sure in many:
                        x = sums.setdefault((talk[i], line[i], code), [0.0, False, 0, 0.0])
                        x[0] = max(x[0], sure)
                        x[1] |= code in told[i]
                        x[2] += 1
                        x[3] += 1.0 / len(many)
                columns = [*zip(*((*key, *x) for key, x in sums.items()))] or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.int64(), pa.float64()))], ["talk_id", "source_line", "lang", "confidence", "named", "n", "weight"])

    schema = "talk_id string, source_line int, lang string, confidence double, named boolean, n bigint, weight double"
    each = both.mapInArrow(run, schema).groupBy("talk_id", "source_line", "lang").agg(F.max("confidence").alias("confidence"), F.bool_or("named").alias("named"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    # a line in several languages has a row for each, whose weights make up one line
    whole = W.partitionBy("talk_id", "source_line")
    kept = each.withColumn("lines", F.round(F.sum("weight").over(whole))).withColumn("_known", F.count("lang").over(whole))
    enough = (F.col("source_line") != 0) | (F.col("n") >= share * F.col("lines") - 1e-9)
    kept = kept.where(F.when(F.col("lang").isNull(), F.col("_known") == 0).otherwise(enough))
    return kept.select("talk_id", "source_line", "lang", "confidence", "named", "n", "lines")
